"""Search, codec, codebook and accounting queries over embeddings, each beside its SQL.

Searches take every row whose id is divisible by 100 as a query, against all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrow import arrow_map, lists, matrix
from ..functions import codecs as C
from ..functions import pack, quantize, vec
from ..functions.rotation import lcg_signs, multiply, rotate, unrotate
from ..functions.wire import FibProfile
from ..operators import search
from ..shared import Scratch
from ..sources.tables import table, vectors
from .common import Plans

D, BITS, N_PROJECTIONS, K, OVERSAMPLE = 64, 3, 32, 10, 4
BOOK = C.initial_codebook(D, 4, 32)
PROJECTIONS = C.projections(N_PROJECTIONS, D, 42)
plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles


def queries_of(v: DataFrame) -> DataFrame:
    return v.where(F.col("id") % 100 == 0)


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- SQL building blocks

_V = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_SIGNS = "[" + ",".join(f"{float(s)}::DOUBLE" for s in lcg_signs(D)) + "]"
_ROT = (
    f"rot AS (SELECT id, label, x, list_transform(range(0, {D}), lambda i: list_sum(list_transform(range(0, {D}), "
    f"lambda j: x[j+1] * ({_SIGNS})[j+1] * (1 - 2 * (bit_count(i & j) % 2)))) / {math.sqrt(D)!r}::DOUBLE) AS y FROM v)"
)
_POLAR = (
    f"code AS (SELECT id, label, x, y, list_transform(range(0, {D // 2}), lambda i: sqrt(y[2*i+1]*y[2*i+1] + y[2*i+2]*y[2*i+2])) AS r, "
    f"list_transform(range(0, {D // 2}), lambda i: CAST(floor(round((atan2(y[2*i+2], y[2*i+1]) + {math.pi!r}::DOUBLE) / {C.PI2!r}::DOUBLE * {1 << BITS}, 12)) AS INTEGER) % {1 << BITS}) AS k FROM rot)"
)
_DEC = (
    f"dec AS (SELECT *, list_transform(range(0, {D}), lambda i: CASE WHEN i % 2 = 0 THEN r[i//2+1] * cos(k[i//2+1] / {1 << BITS}::DOUBLE * {C.PI2!r}::DOUBLE - {math.pi!r}::DOUBLE) "
    f"ELSE r[i//2+1] * sin(k[i//2+1] / {1 << BITS}::DOUBLE * {C.PI2!r}::DOUBLE - {math.pi!r}::DOUBLE) END) AS z FROM code)"
)
_CODES = f"WITH {_V}, {_ROT}, {_POLAR}, {_DEC}"


def _top(score: str, name: str, source: str, with_: str, k: int) -> str:
    return (
        f"{with_}, {name}_s AS (SELECT q.id AS q, c.id AS id, round({score}, 9) AS score FROM {source} q, {source} c WHERE q.id % 100 = 0), "
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) - 1 AS rank FROM {name}_s) WHERE rank < {k})"
    )


_IP, _COS, _L2 = (
    "list_inner_product(q.x, c.x)",
    "list_inner_product(q.x, c.x) / (sqrt(list_inner_product(q.x, q.x)) * sqrt(list_inner_product(c.x, c.x)))",
    "-sqrt(greatest(0, list_inner_product(q.x, q.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(q.x, c.x)))",
)
_OUT = "SELECT q, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM "


def _search(spark, sf_dir, metric):
    v = vectors(spark, sf_dir)
    found = search.top_k(v, queries_of(v), K, metric)
    return found.select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


@plans.add(_top(_IP, "t", "v", f"WITH {_V}", K) + _OUT + "t")
def exact_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "ip")


@plans.add(_top(_COS, "t", "v", f"WITH {_V}", K) + _OUT + "t")
def exact_topk_cosine(spark, sf_dir):
    return _search(spark, sf_dir, "cosine")


@plans.add(_top(_L2, "t", "v", f"WITH {_V}", K) + _OUT + "t")
def exact_topk_l2(spark, sf_dir):
    return _search(spark, sf_dir, "l2")


# ---------------------------------------------------------------- codecs


def rotated(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("y", rotate("x", D))


def coded(spark, sf_dir) -> DataFrame:
    y = F.col("y")
    return rotated(spark, sf_dir).withColumns({"r": C.radii(y), "k": C.angles(y, BITS)})


def decoded(spark, sf_dir) -> DataFrame:
    return coded(spark, sf_dir).withColumn("z", C.polar_decode(F.col("r"), F.col("k"), BITS))


@plans.add(f"WITH {_V}, {_ROT} SELECT id, round(sqrt(list_inner_product(x, x)), 6) AS before, round(sqrt(list_inner_product(y, y)), 6) AS after, round(y[1], 6) AS first FROM rot")
def rotate_hadamard_norms(spark, sf_dir):
    y = F.col("y")
    return rotated(spark, sf_dir).select("id", r6(vec.norm(F.col("x"))).alias("before"), r6(vec.norm(y)).alias("after"), r6(y[0]).alias("first"))


@plans.add(f"WITH {_V}, {_ROT}, {_POLAR} SELECT id, CAST(p AS BIGINT) AS pair, round(r[p+1], 6) AS radius, CAST(k[p+1] AS BIGINT) AS angle FROM (SELECT id, r, k, unnest(range(0, {D // 2})) AS p FROM code)")
def polar_encode(spark, sf_dir):
    pairs = F.posexplode(F.arrays_zip("r", "k"))
    return coded(spark, sf_dir).select("id", pairs.alias("p", "c")).select(
        "id", F.col("p").cast("bigint").alias("pair"), r6("c.r").alias("radius"), F.col("c.k").cast("bigint").alias("angle")
    )


@plans.add(f"{_CODES} SELECT id, round(list_sum(list_transform(range(1, {D + 1}), lambda i: (y[i]-z[i])*(y[i]-z[i]))) / {D}, 6) AS mse FROM dec")
def polar_decode_mse(spark, sf_dir):
    return decoded(spark, sf_dir).select("id", r6(vec.mse(F.col("x"), unrotate("z", D))).alias("mse"))


def _compressed(spark, sf_dir, k, d=None) -> DataFrame:
    """Rotated queries against decoded codes."""
    d = decoded(spark, sf_dir) if d is None else d
    return search.top_k(d.select("id", F.col("z").alias("x")), queries_of(d).select("id", F.col("y").alias("x")), k)


_ZIP = "list_inner_product(q.y, c.z)"
_CAND = _top(_ZIP, "cand", "dec", _CODES, search.candidates(K, OVERSAMPLE))


@plans.add(_CAND + ", st AS (SELECT q, count(*) AS n, round(sum(score), 6) AS total, round(max(score), 6) AS best FROM cand GROUP BY q) SELECT * FROM st")
def polar_score(spark, sf_dir):
    found = _compressed(spark, sf_dir, search.candidates(K, OVERSAMPLE))
    return found.groupBy("q").agg(F.count("*").alias("n"), r6(F.sum("score")).alias("total"), r6(F.max("score")).alias("best"))


@plans.add(_CAND + _OUT + "cand")
def polar_topk_candidates(spark, sf_dir):
    found = _compressed(spark, sf_dir, search.candidates(K, OVERSAMPLE))
    return found.select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


@plans.add(_CAND + ", t AS (SELECT c.q, min(round(sqrt(greatest(0, list_inner_product(a.y, a.y) + list_inner_product(b.r, b.r) - 2 * c.score)), 6)) AS nearest, count(*) AS n FROM cand c JOIN dec a ON a.id = c.q JOIN dec b ON b.id = c.id GROUP BY c.q) SELECT * FROM t")
def polar_l2(spark, sf_dir):
    d = decoded(spark, sf_dir)
    found = _compressed(spark, sf_dir, search.candidates(K, OVERSAMPLE)).select("q", "id", "score")
    met = found.join(d.select("id", "r"), "id").join(d.select(F.col("id").alias("q"), "y"), "q")
    return met.groupBy("q").agg(r6(F.min(F.sqrt(C.polar_l2(F.col("y"), F.col("r"), F.col("score"))))).alias("nearest"), F.count("*").alias("n"))


_EX = ", ex_s AS (SELECT q.id AS q, c.id AS id, round(list_inner_product(q.x, c.x), 9) AS score FROM dec q, dec c WHERE q.id % 100 = 0), ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) - 1 AS rank FROM ex_s) WHERE rank < 10)"
_RR = ", rr_s AS (SELECT c.q, c.id, e.score FROM cand c JOIN ex_s e ON e.q = c.q AND e.id = c.id), rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) - 1 AS rank FROM rr_s) WHERE rank < 10)"


def _three(spark, sf_dir):
    """Exact best, candidates by codes, and these ranked again; the candidates are stored, as two results read them."""
    v = vectors(spark, sf_dir)
    cand = Scratch(spark, "search").store("candidates", _compressed(spark, sf_dir, search.candidates(K, OVERSAMPLE)))
    return search.top_k(v, queries_of(v), K), cand, search.rerank(cand, v, queries_of(v), K)


@plans.add(_CAND + _EX + _RR + _OUT + "rr")
def rerank_topk(spark, sf_dir):
    found = _three(spark, sf_dir)[2]
    return found.select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


@plans.add(_CAND + _EX + _RR + ", h AS (SELECT (SELECT count(*) FROM ex JOIN rr USING (q, id)) AS reranked, (SELECT count(*) FROM ex JOIN cand USING (q, id) WHERE cand.rank < 10) AS approx, (SELECT count(*) FROM ex JOIN cand USING (q, id)) AS found, (SELECT count(*) FROM ex) AS expected) SELECT reranked, approx, found, expected, round(reranked / expected, 6) AS recall FROM h")
def recall_at_k(spark, sf_dir):
    exact, cand, again = _three(spark, sf_dir)
    hit = lambda d, name: d.select("q", "id", F.lit(1).alias(name))
    met = exact.select("q", "id").join(hit(again, "a"), ["q", "id"], "left").join(hit(cand.where(f"rank < {K}"), "b"), ["q", "id"], "left").join(hit(cand, "c"), ["q", "id"], "left")
    n = lambda c: F.count(c)
    return met.agg(n("a").alias("reranked"), n("b").alias("approx"), n("c").alias("found"), F.count("*").alias("expected"), r6(F.try_divide(n("a"), F.count("*"))).alias("recall"))


@plans.add(_CAND + _EX + ", d AS (SELECT ex.q, abs(ex.rank - cand.rank) AS drift, abs(ex.score - cand.score) AS error FROM ex JOIN cand ON ex.q = cand.q AND ex.id = cand.id) SELECT q, count(*) AS n, CAST(max(drift) AS BIGINT) AS max_drift, round(avg(drift), 6) AS mean_drift FROM d GROUP BY q")
def rank_drift(spark, sf_dir):
    exact, cand, _ = _three(spark, sf_dir)
    met = exact.select("q", "id", "rank").join(cand.select("q", "id", F.col("rank").alias("other")), ["q", "id"])
    drift = F.abs(F.col("rank") - F.col("other"))
    return met.groupBy("q").agg(F.count("*").alias("n"), F.max(drift).cast("bigint").alias("max_drift"), r6(F.avg(drift)).alias("mean_drift"))


@plans.add(_CAND + _EX + ", e AS (SELECT cand.q, abs(ex_s.score - cand.score) AS error FROM cand JOIN ex_s ON ex_s.q = cand.q AND ex_s.id = cand.id), o AS (SELECT q, error, row_number() OVER (PARTITION BY q ORDER BY error) - 1 AS i, count(*) OVER (PARTITION BY q) AS n FROM e) SELECT q, round(avg(error), 6) AS mae, round(max(error), 6) AS worst, round(max(CASE WHEN i = floor((n - 1) * 0.95 + 0.5) THEN error END), 6) AS p95 FROM o GROUP BY q")
def score_error_stats(spark, sf_dir):
    v = vectors(spark, sf_dir)
    cand = _compressed(spark, sf_dir, search.candidates(K, OVERSAMPLE))
    exact = search.rerank(cand, v, queries_of(v), search.candidates(K, OVERSAMPLE)).select("q", "id", F.col("score").alias("exact"))
    error = cand.join(exact, ["q", "id"]).select("q", F.abs(F.col("exact") - F.col("score")).alias("error"))
    w = Window.partitionBy("q")
    # nearest rank at round((n - 1) p)
    ranked = error.withColumns({"i": F.row_number().over(w.orderBy("error")) - 1, "n": F.count("*").over(w)})
    p95 = F.when(F.col("i") == F.floor((F.col("n") - 1) * 0.95 + 0.5), F.col("error"))
    return ranked.groupBy("q").agg(r6(F.avg("error")).alias("mae"), r6(F.max("error")).alias("worst"), r6(F.max(p95)).alias("p95"))


# ---------------------------------------------------------------- sign sketches

_PROJ = "[" + ",".join("[" + ",".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in PROJECTIONS.tolist()) + "]"
_SK = f"p AS (SELECT {_PROJ} AS m), sk AS (SELECT id, x, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: list_inner_product(m[i], x)) AS px FROM v, p)"
_QJL = f"{math.sqrt(math.pi / 2)!r}::DOUBLE * list_sum(list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: CASE WHEN c.px[i] >= 0 THEN q.px[i] ELSE -q.px[i] END)) / {N_PROJECTIONS}"


def sketched(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("px", multiply(PROJECTIONS, "x"))


@plans.add(f"WITH {_V}, {_SK} SELECT id, CAST(list_sum(list_transform(px, lambda z: CASE WHEN z >= 0 THEN 1 ELSE 0 END)) AS BIGINT) AS ones, CAST(CASE WHEN px[1] >= 0 THEN 1 ELSE -1 END AS BIGINT) AS first FROM sk")
def qjl_sketch(spark, sf_dir):
    s = C.signs(F.col("px"))
    return sketched(spark, sf_dir).select("id", F.size(F.filter(s, lambda z: z > 0)).cast("bigint").alias("ones"), s[0].cast("bigint").alias("first"))


def _qjl(spark, sf_dir, stored_norm: bool):
    """The estimate is an inner product of the projected query with scaled signs: a search."""
    s = sketched(spark, sf_dir)
    by = math.sqrt(math.pi / 2) / N_PROJECTIONS * (vec.norm(F.col("x")) if stored_norm else F.lit(1.0))
    return search.top_k(s.select("id", vec.scale(C.signs(F.col("px")), by).alias("x")), queries_of(s).select("id", F.col("px").alias("x")), K)


@plans.add(_top(_QJL, "t", "sk", f"WITH {_V}, {_SK}", K) + " SELECT q, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM t")
def qjl_score_unit(spark, sf_dir):
    return _qjl(spark, sf_dir, False).select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


@plans.add(_top(_QJL + " * sqrt(list_inner_product(c.x, c.x))", "t", "sk", f"WITH {_V}, {_SK}", K) + " SELECT q, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM t")
def qjl_score_norm(spark, sf_dir):
    return _qjl(spark, sf_dir, True).select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


def turbo_coded(spark, sf_dir) -> DataFrame:
    """Polar code with bits - 1 and the sign sketch of what it leaves over."""
    d = decoded(spark, sf_dir)
    return d.withColumn("residual", F.zip_with("y", "z", lambda a, b: a - b)).withColumn("pr", multiply(PROJECTIONS, "residual"))


_TB = f"{_CODES}, p AS (SELECT {_PROJ} AS m), tb AS (SELECT id, x, y, z, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: list_inner_product(m[i], list_transform(range(1, {D + 1}), lambda j: y[j] - z[j]))) AS pr, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: list_inner_product(m[i], y)) AS py FROM dec, p)"
_TBS = f"list_inner_product(q.y, c.z) + {math.sqrt(math.pi / 2)!r}::DOUBLE * list_sum(list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: CASE WHEN c.pr[i] >= 0 THEN q.py[i] ELSE -q.py[i] END)) / {N_PROJECTIONS}"


def _turbo(spark, sf_dir, k):
    """Both estimates are inner products, so the code is one longer vector."""
    t = turbo_coded(spark, sf_dir).withColumn("py", multiply(PROJECTIONS, "y"))
    code = F.concat("z", vec.scale(C.signs(F.col("pr")), F.lit(math.sqrt(math.pi / 2) / N_PROJECTIONS)))
    return search.top_k(t.select("id", code.alias("x")), queries_of(t).select("id", F.concat("y", "py").alias("x")), k)


@plans.add(_top(_TBS, "t", "tb", _TB, K) + " SELECT q, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM t")
def turbo_topk(spark, sf_dir):
    return _turbo(spark, sf_dir, K).select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


# ---------------------------------------------------------------- radii, grids, codebook

_R = f"WITH {_V}, {_ROT}, {_POLAR}, rr AS (SELECT id, r, list_min(r) AS lo, list_max(r) AS hi FROM code)"


@plans.add(_R + f" SELECT id, CAST(list_sum(list_transform(r, lambda z: floor((z - lo) / greatest(hi - lo, {C.F32_EPS!r}::DOUBLE) * 65535 + 0.5))) AS BIGINT) AS total FROM rr")
def radii_linear_u16(spark, sf_dir):
    k = C.radii_u16(F.col("r"))
    return coded(spark, sf_dir).select("id", F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


_LOG = f"ln(greatest(z, {C.F32_MIN!r}::DOUBLE))"
_U8 = _R + f", l AS (SELECT id, r, list_transform(r, lambda z: {_LOG}) AS g FROM rr), lk AS (SELECT id, r, list_min(g) AS lo, list_max(g) AS hi, list_transform(g, lambda z: floor((z - list_min(g)) / greatest(list_max(g) - list_min(g), {C.F32_EPS!r}::DOUBLE) * 255 + 0.5)) AS k FROM l)"


@plans.add(_U8 + " SELECT id, CAST(list_sum(k) AS BIGINT) AS total, CAST(list_max(k) AS BIGINT) AS most FROM lk")
def radii_log_u8(spark, sf_dir):
    k = C.radii_u8(F.col("r"))
    return coded(spark, sf_dir).select("id", F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max(k).cast("bigint").alias("most"))


@plans.add(_U8 + f" SELECT id, round(list_max(list_transform(range(1, {D // 2 + 1}), lambda i: abs(exp(lo + k[i] / 255.0::DOUBLE * (hi - lo)) - r[i]) / greatest(r[i], {C.F32_MIN!r}::DOUBLE))), 6) AS error FROM lk")
def radii_rel_error(spark, sf_dir):
    logs = F.transform("r", lambda x: F.log(F.greatest(x, F.lit(C.F32_MIN))))
    back = C.radii_u8_decode(C.radii_u8(F.col("r")), F.array_min(logs), F.array_max(logs))
    error = F.zip_with(back, "r", lambda a, b: F.abs(a - b) / F.greatest(b, F.lit(C.F32_MIN)))
    return coded(spark, sf_dir).select("id", r6(F.array_max(error)).alias("error"))


_SQ = "CAST(least(floor(round(least(greatest(l_discount, 0.0), 0.1) / 0.1::DOUBLE * 16, 9)), 15) AS BIGINT)"


@plans.add(f"SELECT {_SQ} AS code, count(*) AS n FROM lineitem GROUP BY 1")
def scalar_quantize(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(C.scalar_code(F.col("l_discount"), 0.0, 0.1, 16).cast("bigint").alias("code")).agg(F.count("*").alias("n"))


@plans.add(f"SELECT code, round((code + 0.5::DOUBLE) * 0.00625::DOUBLE, 6) AS value, round(max(abs(l_discount - (code + 0.5::DOUBLE) * 0.00625::DOUBLE)), 6) AS worst FROM (SELECT l_discount, {_SQ} AS code FROM lineitem) GROUP BY 1, 2")
def scalar_dequantize(spark, sf_dir):
    k = C.scalar_code(F.col("l_discount"), 0.0, 0.1, 16).cast("bigint")
    value = C.scalar_value(F.col("code"), 0.0, 0.1, 16)
    rows = table(spark, sf_dir, "lineitem").select("l_discount", k.alias("code"))
    return rows.groupBy("code", r6(value).alias("value")).agg(r6(F.max(F.abs(F.col("l_discount") - value))).alias("worst"))


_BOOK = "bk AS (SELECT unnest(range(0, 32)) AS w, unnest([" + ",".join("[" + ",".join(f"{x!r}::DOUBLE" for x in w) + "]" for w in BOOK) + "]) AS word)"
_NEAR = f"blk AS (SELECT id, b, list_transform(range(1, 5), lambda j: y[4*b+j] / nrm) AS s, nrm FROM (SELECT id, y, sqrt(list_inner_product(y, y)) AS nrm, unnest(range(0, {D // 4})) AS b FROM rot)), asg AS (SELECT id, b, s, nrm, min(struct_pack(d := round(list_sum(list_transform(range(1, 5), lambda j: (s[j]-word[j])*(s[j]-word[j]))), 12), w := w)) AS m FROM blk, bk GROUP BY ALL)"
_FIB = f"WITH {_V}, {_ROT}, {_BOOK}, {_NEAR}"


def assigned(spark, sf_dir) -> DataFrame:
    """(id, b, s, nrm, m): unit blocks with their nearest codeword, a matrix of distances per slice of rows."""
    book = quantize.fib(FibProfile(D))

    def rows(batch):
        y = matrix(batch.column("y"))
        nrm = np.sqrt((y * y).sum(1))
        s = (y / nrm[:, None]).reshape(-1, 4)
        at, d = book.nearest(s)
        n = D // 4
        m = pa.StructArray.from_arrays([pa.array(d), pa.array(at.astype(np.int64))], ["d", "w"])
        return {"id": np.repeat(batch.column("id").to_numpy(), n), "b": np.tile(np.arange(n), len(y)), "s": lists(s), "nrm": np.repeat(nrm, n), "m": m}

    return arrow_map(rotated(spark, sf_dir).select("id", "y"), rows, "id bigint, b int, s array<double>, nrm double, m struct<d:double,w:bigint>")


@plans.add(_FIB + " SELECT id, CAST(b AS BIGINT) AS block, CAST(m.w AS BIGINT) AS word FROM asg")
def fib_encode(spark, sf_dir):
    return assigned(spark, sf_dir).select("id", F.col("b").cast("bigint").alias("block"), F.col("m.w").alias("word"))


@plans.add(_FIB + f" SELECT id, round(sum(m.d) * max(nrm * nrm) / {D}, 6) AS mse FROM asg GROUP BY id")
def fib_decode_mse(spark, sf_dir):
    return assigned(spark, sf_dir).groupBy("id").agg(r6(F.sum("m.d") * F.max(F.col("nrm") * F.col("nrm")) / D).alias("mse"))


@plans.add(_FIB + " SELECT id, round(sum(list_inner_product(s, word)) / sqrt(sum(list_inner_product(word, word))), 6) AS cosine FROM asg JOIN bk ON bk.w = m.w GROUP BY id")
def fib_cosine(spark, sf_dir):
    book = spark.createDataFrame([(i, w) for i, w in enumerate(BOOK)], "w bigint, word array<double>")
    a = assigned(spark, sf_dir).withColumn("w", F.col("m.w")).join(F.broadcast(book), "w")  # 32 rows
    s, w = F.col("s"), F.col("word")
    return a.groupBy("id").agg(r6(F.sum(vec.dot(s, w)) / F.sqrt(F.sum(vec.dot(w, w)))).alias("cosine"))


@plans.add(_FIB + " SELECT CAST(m.w AS BIGINT) AS word, count(*) AS n FROM asg GROUP BY 1")
def lloyd_assign(spark, sf_dir):
    return assigned(spark, sf_dir).groupBy(F.col("m.w").alias("word")).agg(F.count("*").alias("n"))


@plans.add(_FIB + " SELECT CAST(m.w AS BIGINT) AS word, round(avg(s[1]), 6) AS c1, round(avg(s[2]), 6) AS c2, round(avg(s[3]), 6) AS c3, round(avg(s[4]), 6) AS c4, round(sum(m.d), 6) AS distortion, round(max(m.d), 6) AS farthest FROM asg GROUP BY 1")
def lloyd_update(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return a.groupBy(F.col("m.w").alias("word")).agg(*[r6(F.avg(F.col("s")[i])).alias(f"c{i + 1}") for i in range(4)], r6(F.sum("m.d")).alias("distortion"), r6(F.max("m.d")).alias("farthest"))


@plans.add(_FIB + " SELECT count(*) AS n, round(sum(m.d) / (count(*) * 4), 6) AS mse FROM asg")
def lloyd_mse(spark, sf_dir):
    return assigned(spark, sf_dir).agg(F.count("*").alias("n"), r6(F.sum("m.d") / (F.count("*") * 4)).alias("mse"))


# ---------------------------------------------------------------- sizes


@plans.add(f"SELECT count(*) AS n, CAST(count(*) * {4 * D} AS BIGINT) AS raw_f32, CAST(count(*) * {2 * D} AS BIGINT) AS raw_f16, CAST(38 + count(*) * {C.turbo_payload(D, 4, 32)} AS BIGINT) AS sidecar, round(count(*) * {4 * D} / (38 + count(*) * {C.turbo_payload(D, 4, 32)}), 6) AS ratio FROM embeddings")
def byte_accounting(spark, sf_dir):
    n = F.count("*")
    sidecar = 38 + n * C.turbo_payload(D, 4, 32)
    return vectors(spark, sf_dir).agg(n.alias("n"), (n * 4 * D).alias("raw_f32"), (n * 2 * D).alias("raw_f16"), sidecar.alias("sidecar"), r6(n * 4 * D / sidecar).alias("ratio"))


@plans.add(f"SELECT CAST(label AS BIGINT) AS label, CAST(19 + count(*) * {C.fb2_bytes(1, D) - 19} AS BIGINT) AS fb2, CAST(count(*) * {C.fb1_bytes(1, D)} AS BIGINT) AS fb1, CAST(38 + count(*) * {C.turbo_payload(D, 8, 32)} AS BIGINT) AS tqb1, CAST(38 + count(*) * {C.turbo_payload(D, 8, 32, True)} AS BIGINT) AS tqb1_lossy, CAST(count(*) * {C.tqw1_bytes(D, 8, 32)} AS BIGINT) AS tqw1 FROM embeddings GROUP BY label")
def wire_sizes(spark, sf_dir):
    n = F.count("*")
    sized = vectors(spark, sf_dir).groupBy(F.col("label").cast("bigint").alias("label"))
    return sized.agg(
        (19 + n * (C.fb2_bytes(1, D) - 19)).alias("fb2"), (n * C.fb1_bytes(1, D)).alias("fb1"), (38 + n * C.turbo_payload(D, 8, 32)).alias("tqb1"),
        (38 + n * C.turbo_payload(D, 8, 32, True)).alias("tqb1_lossy"), (n * C.tqw1_bytes(D, 8, 32)).alias("tqw1"),
    )


_SYS = f"p AS (SELECT count(*) AS shared, 19 + count(*) * {C.fb2_bytes(1, D) - 19} AS pool FROM embeddings), s AS (SELECT conv_id, count(*) AS own, 38 + count(*) * {C.turbo_payload(D, 4, 32)} AS shell FROM conversations GROUP BY conv_id)"


@plans.add(f"WITH {_SYS} SELECT count(*) AS agents, CAST(max(pool) AS BIGINT) AS pool, CAST(sum(shell) AS BIGINT) AS shells, CAST(sum(shared + own) * {4 * D} AS BIGINT) AS raw, round(sum(shared + own) * {4 * D} / (max(pool) + sum(shell)), 6) AS ratio FROM p, s")
def system_ratio(spark, sf_dir):
    """One shared pool and a shell per conversation against every agent's own raw copy."""
    n = F.count("*")
    pool = vectors(spark, sf_dir).agg(n.alias("shared"), (19 + n * (C.fb2_bytes(1, D) - 19)).alias("pool"))
    shells = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("own"), (38 + n * C.turbo_payload(D, 4, 32)).alias("shell"))
    both = shells.join(F.broadcast(pool))  # the pool is one row
    raw = F.sum(F.col("shared") + F.col("own")) * 4 * D
    return both.agg(n.alias("agents"), F.max("pool").alias("pool"), F.sum("shell").alias("shells"), raw.alias("raw"), r6(raw / (F.max("pool") + F.sum("shell"))).alias("ratio"))


@plans.add(f"WITH {_SYS}, o AS (SELECT row_number() OVER (ORDER BY conv_id) AS agents, sum(own) OVER (ORDER BY conv_id) AS own, sum(shell) OVER (ORDER BY conv_id) AS shells FROM s) SELECT CAST(agents AS BIGINT) AS agents, round((agents * shared + own) * {4 * D} / (pool + shells), 6) AS ratio FROM o, p")
def n_agent_scaling(spark, sf_dir):
    """Ratio as agents join one by one; running sums by range bucket, then within it."""
    n = F.count("*")
    pool = vectors(spark, sf_dir).agg(n.alias("shared"), (19 + n * (C.fb2_bytes(1, D) - 19)).alias("pool"))
    shells = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n.alias("own"), (38 + n * C.turbo_payload(D, 4, 32)).alias("shell"))
    dealt = shells.withColumn("bucket", F.floor(F.col("conv_id") / 10_000))
    sums = dealt.groupBy("bucket").agg(n.alias("n0"), F.sum("own").alias("own0"), F.sum("shell").alias("shell0"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per 10,000 agents
    base = sums.select("bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n0", "own0", "shell0")])
    w = Window.partitionBy("bucket").orderBy("conv_id")
    run = dealt.join(base, "bucket").join(F.broadcast(pool))
    agents = F.col("n0") + F.row_number().over(w)
    own, size = F.col("own0") + F.sum("own").over(w), F.col("shell0") + F.sum("shell").over(w)
    return run.select(agents.alias("agents"), r6((agents * F.col("shared") + own) * 4 * D / (F.col("pool") + size)).alias("ratio"))


@plans.add(f"WITH {_V} SELECT count(*) AS n, round(avg(sqrt(list_inner_product(x, x))), 6) AS mean_norm, round(max(sqrt(list_inner_product(x, x))), 6) AS max_norm, count(*) FILTER (sqrt(list_inner_product(x, x)) > 1.5) AS outliers FROM v")
def calibration_summary(spark, sf_dir):
    size = vec.norm(F.col("x"))
    return vectors(spark, sf_dir).agg(F.count("*").alias("n"), r6(F.avg(size)).alias("mean_norm"), r6(F.max(size)).alias("max_norm"), F.count_if(size > 1.5).alias("outliers"))


# ---------------------------------------------------------------- bits


@plans.add(f"SELECT vec_id AS id, CAST({D // 2 * BITS // 8} AS INTEGER) AS bytes, true AS same FROM embeddings")
def bitpack_roundtrip(spark, sf_dir):
    t = coded(spark, sf_dir).withColumn("raw", pack.packed_column(BITS)("k")).withColumn("back", pack.unpacked_column(BITS, D // 2)("raw"))
    return t.select("id", F.octet_length("raw").alias("bytes"), (F.col("k") == F.col("back")).alias("same"))
