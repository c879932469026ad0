"""Codes, blobs and codebooks over embeddings, each beside its SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import pack, registry, rules, vec
from ..functions.rotation import lcg_signs
from ..functions.wire import FibProfile, TurboProfile
from ..operators import codes, lloyd, search, store
from ..sources.tables import table, vectors
from .common import Plans
from .vector_queries import _CODES, _FIB, _PROJ, _V, BOOK, D, K, N_PROJECTIONS, queries_of, r6

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles
TURBO, FIB = TurboProfile(D, 4, N_PROJECTIONS), FibProfile(D)
BLOB_TOKENS = 1024
_PI = f"{math.pi!r}::DOUBLE"


def signs_sql(n: int, seed: int = 42) -> str:
    return "[" + ",".join(f"{float(s)}::DOUBLE" for s in lcg_signs(n, seed)) + "]"


def back_sql(z: str, n: int, seed: int = 42) -> str:
    """A rotated list turned back: the transform is its own inverse but for the signs."""
    h = f"list_sum(list_transform(range(0, {n}), lambda i: {z}[i+1] * (1 - 2 * (bit_count(i & j) % 2)))) / {math.sqrt(n)!r}::DOUBLE"
    return f"list_transform(range(0, {n}), lambda j: {h} * ({signs_sql(n, seed)})[j+1])"


def rotated_sql(x: str, n: int, seed: int = 42) -> str:
    return f"list_transform(range(0, {n}), lambda i: list_sum(list_transform(range(0, {n}), lambda j: {x}[j+1] * ({signs_sql(n, seed)})[j+1] * (1 - 2 * (bit_count(i & j) % 2)))) / {math.sqrt(n)!r}::DOUBLE)"


def turbo_sql(source: str, name: str, n: int, bits: int, seed: int = 42, single: bool = False) -> str:
    """CTEs that code the list x of a source: name_y, name_c and name with (*, r, k, z); radii in single precision if asked."""
    r = "sqrt(y[2*i+1]*y[2*i+1] + y[2*i+2]*y[2*i+2])"
    kept = "list_transform(r0, lambda v: CAST(CAST(v AS FLOAT) AS DOUBLE))" if single else "r0"
    level = f"CAST(floor(round((atan2(y[2*i+2], y[2*i+1]) + {_PI}) / (2 * {_PI}) * {1 << bits}, 12)) AS INTEGER) % {1 << bits}"
    at = f"(k[i//2+1] / {1 << bits}::DOUBLE * (2 * {_PI}) - {_PI})"
    return (
        f"{name}_y AS (SELECT *, {rotated_sql('x', n, seed)} AS y FROM {source}), "
        f"{name}_c AS (SELECT *, list_transform(range(0, {n // 2}), lambda i: {r}) AS r0, list_transform(range(0, {n // 2}), lambda i: {level}) AS k FROM {name}_y), "
        f"{name}_r AS (SELECT *, {kept} AS r FROM {name}_c), "
        f"{name} AS (SELECT *, list_transform(range(0, {n}), lambda i: r[i//2+1] * CASE WHEN i % 2 = 0 THEN cos({at}) ELSE sin({at}) END) AS z FROM {name}_r)"
    )


def matrix_sql(m: np.ndarray) -> str:
    return "[" + ",".join("[" + ",".join(f"{x!r}::DOUBLE" for x in row) + "]" for row in m.tolist()) + "]"


def top_sql(score: str, source: str, with_: str, k: int) -> str:
    return (
        f"{with_}, sc AS (SELECT q.id AS q, c.id AS id, round({score}, 9) AS score FROM {source} q, {source} c WHERE q.id % 100 = 0), "
        f"tp AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) - 1 AS rank FROM sc)"
    ) + f" SELECT q, id, CAST(rank AS BIGINT) AS rank, {{}} FROM tp WHERE rank < {k}"


# ---------------------------------------------------------------- blobs

_TURBO_ROW = 4 * (D // 2) + D // 2 * 3 // 8 + N_PROJECTIONS // 8


@plans.add(f"SELECT vec_id AS id, CAST({46 + _TURBO_ROW} AS INTEGER) AS bytes, true AS radii, true AS angles, true AS signs FROM embeddings")
def wire_roundtrip(spark, sf_dir):
    """Single blobs read back: angles and signs as they were, radii in single precision."""
    c = codes.turbo_codes(vectors(spark, sf_dir), TURBO)
    blobs = codes.turbo_blobs(c, TURBO)
    back = codes.turbo_of_blobs(blobs, TURBO).select("id", *[F.col(n).alias(f"b_{n}") for n in ("radii", "angles", "signs")])
    met = blobs.join(c, "id").join(back, "id")
    single = F.transform("radii", lambda v: v.cast("float").cast("double"))
    return met.select("id", F.octet_length("blob").alias("bytes"), (single == F.col("b_radii")).alias("radii"), (F.col("angles") == F.col("b_angles")).alias("angles"), (F.col("signs") == F.col("b_signs")).alias("signs"))


@plans.add(f"SELECT vec_id AS id, {D} AS dim, 3 AS angle_bits, {N_PROJECTIONS} AS projections, CAST(42 AS BIGINT) AS seed, {D // 2} AS pairs, CAST({_TURBO_ROW} AS BIGINT) AS payload, 'auto' AS rotation FROM embeddings")
def wire_headers(spark, sf_dir):
    """What the headers of blobs say, payloads unread."""
    return codes.headers_of_blobs(codes.turbo_blobs(codes.turbo_codes(vectors(spark, sf_dir), TURBO), TURBO))


@plans.add(f"SELECT vec_id AS id, CAST({11 + 2 + 10} AS INTEGER) AS bytes, true AS words, true AS norm FROM embeddings")
def fb1_roundtrip(spark, sf_dir):
    c = codes.fib_codes(vectors(spark, sf_dir), FIB)
    blobs = codes.fib_blobs(c, FIB)
    back = codes.fib_of_blobs(blobs, FIB).select("id", F.col("norm").alias("b_norm"), F.col("words").alias("b_words"))
    met = blobs.join(c, "id").join(back, "id")
    return met.select("id", F.octet_length("blob").alias("bytes"), (F.col("words") == F.col("b_words")).alias("words"), (F.abs(F.col("norm") / F.col("b_norm") - 1) < 1e-3).alias("norm"))


_IDS = {"fib_k4_n32_batched": (19, 2 + 10), "fib_k4_n32_batched_f32": (19, 4 + 10), "turbo_4bit_batched": (38, 144), "turbo_8bit_batched": (38, 160), "turbo_8bit_batched_lossy": (38, 72), "exact_f32_fallback": (0, 256)}


def _placed(spark, sf_dir):
    """The embeddings as one sequence of one head: ids count from 0."""
    return vectors(spark, sf_dir).select(F.col("id").alias("pos"), F.lit(0).alias("head"), "x")


@plans.add("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS codec, CAST(vec_id // {BLOB_TOKENS} AS BIGINT) AS chunk, count(*) AS vectors, CAST({h} + count(*) * {r} AS BIGINT) AS bytes, true AS near FROM embeddings GROUP BY 1, 2" for c, (h, r) in _IDS.items()) + ")")
def batch_bytes(spark, sf_dir):
    """Batches by each codec of the registry: bytes produced, and whether what is read back is near."""
    v = _placed(spark, sf_dir)
    out = None
    for codec in _IDS:
        blobs = store.encode_blobs(v, [], codec, D, BLOB_TOKENS)
        back = store.decode_blobs(blobs, [], store.Shape(1, 1, D)).select("pos", F.col("x").alias("y"))
        near = v.join(back, "pos", "left").groupBy(F.floor(F.col("pos") / BLOB_TOKENS).alias("chunk")).agg(F.min(F.coalesce(vec.cosine(F.col("x"), F.col("y")), F.lit(-1.0))).alias("least"))
        one = blobs.join(near, "chunk").select(F.lit(codec).alias("codec"), "chunk", F.col("n_vectors").alias("vectors"), "bytes", (F.col("least") > 0.5).alias("near"))
        out = one if out is None else out.unionByName(one)
    return out


@plans.add(f"SELECT CAST(vec_id // {BLOB_TOKENS} AS BIGINT) AS chunk, count(*) AS counted, CAST(19 + count(*) * 12 AS BIGINT) AS bytes FROM embeddings GROUP BY 1")
def fb2_counts(spark, sf_dir):
    """Vectors of a batch from its header alone: bytes 10 to 13, low byte first."""
    blobs = store.encode_blobs(_placed(spark, sf_dir), [], "fib_k4_n32_batched", D, BLOB_TOKENS)
    byte = lambda i: F.conv(F.hex(F.expr(f"substring(payload, {11 + i}, 1)")), 16, 10).cast("bigint") * (1 << 8 * i)
    return blobs.select("chunk", (byte(0) + byte(1) + byte(2) + byte(3)).alias("counted"), "bytes")


# ---------------------------------------------------------------- decoding and estimates

_TB4 = f"WITH {_V}, " + turbo_sql("v", "tb", D, 3) + f", p AS (SELECT {_PROJ} AS m), pr AS (SELECT id, x, y, z, r, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: CASE WHEN list_inner_product(m[i], list_transform(range(1, {D + 1}), lambda j: y[j] - z[j])) >= 0 THEN 1 ELSE -1 END) AS s, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: list_inner_product(m[i], y)) AS py FROM tb, p)"
_EST = f"(list_inner_product(q.y, c.z) + {math.sqrt(math.pi / 2)!r}::DOUBLE * list_sum(list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: c.s[i] * q.py[i])) / {N_PROJECTIONS})"


def _turbo(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v, codes.turbo_codes(v, TURBO)


@plans.add(f"{_TB4}, b AS (SELECT id, x, {back_sql('z', D)} AS d FROM pr) SELECT id, round(d[1], 6) AS first, round(d[{D}], 6) AS last, round(list_sum(list_transform(range(1, {D + 1}), lambda i: (x[i]-d[i])*(x[i]-d[i]))) / {D}, 6) AS mse FROM b")
def turbo_decode(spark, sf_dir):
    """Vectors rebuilt from angles and radii."""
    v, c = _turbo(spark, sf_dir)
    met = v.join(codes.turbo_vectors(c, TURBO).select("id", F.col("x").alias("d")), "id")
    return met.select("id", r6(F.col("d")[0]).alias("first"), r6(F.col("d")[D - 1]).alias("last"), r6(vec.mse(F.col("x"), F.col("d"))).alias("mse"))


@plans.add(top_sql(f"2 * {_EST} - list_inner_product(c.r, c.r)", "pr", _TB4.replace("SELECT id, x, y, z, r,", "SELECT id, x, y, z, r, list_inner_product(y, y) AS n2,"), K).format("round(sqrt(greatest(0, (SELECT n2 FROM pr WHERE pr.id = q) - score)), 6) AS distance"))
def turbo_l2(spark, sf_dir):
    """The nearest codes by the distance estimate, floored at zero; one search over longer vectors."""
    v, c = _turbo(spark, sf_dir)
    size = F.col("radii")
    coded = codes.turbo_search_vectors(c, TURBO).join(c.select("id", vec.dot(size, size).alias("r2")), "id")
    coded = coded.select("id", F.concat(vec.scale(F.col("x"), F.lit(2.0)), F.array(-F.col("r2"))).alias("x"))
    asked = codes.turbo_query_vectors(queries_of(v), TURBO).select("id", F.concat("x", F.array(F.lit(1.0))).alias("x"))
    norm = queries_of(v).select(F.col("id").alias("q"), vec.dot(F.col("x"), F.col("x")).alias("n2"))
    found = search.top_k(coded, asked, K).join(norm, "q")
    return found.select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6(F.sqrt(F.greatest(F.lit(0.0), F.col("n2") - F.col("score")))).alias("distance"))


_TBF = f"WITH {_V}, " + turbo_sql("v", "tb", D, 3, single=True) + f", p AS (SELECT {_PROJ} AS m), zz AS (SELECT *, list_transform(range(0, {D}), lambda i: r0[i//2+1] * CASE WHEN i % 2 = 0 THEN cos(k[i//2+1] / 8::DOUBLE * (2 * {_PI}) - {_PI}) ELSE sin(k[i//2+1] / 8::DOUBLE * (2 * {_PI}) - {_PI}) END) AS z0 FROM tb), pr AS (SELECT id, y, z, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: CASE WHEN list_inner_product(m[i], list_transform(range(1, {D + 1}), lambda j: y[j] - z0[j])) >= 0 THEN 1 ELSE -1 END) AS s, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: list_inner_product(m[i], y)) AS py FROM zz, p)"


@plans.add(top_sql(_EST, "pr", _TBF, K).format("round(score, 6) AS score"))
def turbo_score(spark, sf_dir):
    """The best codes by the unit-norm estimate, scored from the bytes of their blobs."""
    v, c = _turbo(spark, sf_dir)
    stored = codes.turbo_of_blobs(codes.turbo_blobs(c, TURBO), TURBO)
    found = search.top_k(codes.turbo_search_vectors(stored, TURBO), codes.turbo_query_vectors(queries_of(v), TURBO), K)
    return found.select("q", "id", F.col("rank").cast("bigint").alias("rank"), r6("score").alias("score"))


@plans.add(f"{_FIB}, w AS (SELECT id, max(nrm) AS nrm, list(word[1] ORDER BY b) AS w1, list(word ORDER BY b) AS ws FROM asg JOIN bk ON bk.w = m.w GROUP BY id), f AS (SELECT id, nrm, flatten(ws) AS z FROM w), d AS (SELECT f.id, x, list_transform({back_sql('z', D)}, lambda a: a * nrm) AS d FROM f JOIN v ON v.id = f.id) SELECT id, round(d[1], 6) AS first, round(d[{D}], 6) AS last, round(list_sum(list_transform(range(1, {D + 1}), lambda i: (x[i]-d[i])*(x[i]-d[i]))) / {D}, 6) AS mse FROM d")
def fib_decode(spark, sf_dir):
    """Vectors rebuilt from codewords and norms."""
    v = vectors(spark, sf_dir)
    met = v.join(codes.fib_vectors(codes.fib_codes(v, FIB), FIB).select("id", F.col("x").alias("d")), "id")
    return met.select("id", r6(F.col("d")[0]).alias("first"), r6(F.col("d")[D - 1]).alias("last"), r6(vec.mse(F.col("x"), F.col("d"))).alias("mse"))


@plans.add(f"{_TB4}, b AS (SELECT id, x, {back_sql('z', D)} AS d FROM pr) SELECT id, CAST({46 + _TURBO_ROW} AS BIGINT) AS encoded_bytes, {2 * D} AS fp16_bytes, {4 * D} AS fp32_bytes, round({2 * D} / {46 + _TURBO_ROW}::DOUBLE, 6) AS ratio_fp16, round({4 * D} / {46 + _TURBO_ROW}::DOUBLE, 6) AS ratio_fp32, round(list_sum(list_transform(range(1, {D + 1}), lambda i: (x[i]-d[i])*(x[i]-d[i]))) / {D}, 6) AS mse, round(list_inner_product(x, d) / sqrt(list_inner_product(x, x) * list_inner_product(d, d)), 6) AS cosine FROM b")
def encode_receipts(spark, sf_dir):
    """A receipt per code: bytes, ratios, what the round trip loses."""
    v, c = _turbo(spark, sf_dir)
    r = codes.receipts(codes.turbo_blobs(c, TURBO), D, v.select("id", "x"), codes.turbo_vectors(c, TURBO))
    return r.select("id", "encoded_bytes", "fp16_bytes", "fp32_bytes", *[r6(n).alias(n) for n in ("ratio_fp16", "ratio_fp32", "mse", "cosine")])


@plans.add(f"WITH {_V}, p AS (SELECT {_PROJ} AS m), s AS (SELECT id, x, list_transform(range(1, {N_PROJECTIONS + 1}), lambda i: list_inner_product(m[i], x)) AS px FROM v, p) SELECT id, CAST(list_sum(list_transform(px, lambda z: CASE WHEN z >= 0 THEN 1 ELSE 0 END)) AS BIGINT) AS ones, round(sqrt(list_inner_product(x, x)), 6) AS source_norm, sha256(CAST(id AS VARCHAR)) AS source_digest FROM s")
def sketch_provenance(spark, sf_dir):
    """Sign sketches with the norm and the digest of their source."""
    from ..functions.rotation import multiply
    from .vector_queries import PROJECTIONS

    s = vectors(spark, sf_dir).withColumn("signs", C.signs(multiply(PROJECTIONS, "x")))
    return s.select("id", F.size(F.filter("signs", lambda z: z > 0)).cast("bigint").alias("ones"), r6(vec.norm(F.col("x"))).alias("source_norm"), F.sha2(F.col("id").cast("string"), 256).alias("source_digest"))


@plans.add(f"{_TB4} SELECT id, CASE WHEN id % 5 = 1 THEN 'radius' WHEN id % 5 = 2 THEN 'angle' WHEN id % 5 = 3 THEN 'sign' WHEN id % 5 = 4 THEN 'pairs,signs' ELSE '' END AS broken FROM pr")
def code_rules(spark, sf_dir):
    """Four kinds of damage to codes, found by the rules they break."""
    c = _turbo(spark, sf_dir)[1]
    kind = F.col("id") % 5
    first = lambda name, v: F.transform(name, lambda a, i: F.when(i == 0, F.lit(v)).otherwise(a))
    hurt = c.select(
        "id", F.when(kind == 1, first("radii", -1.0)).when(kind == 4, F.slice("radii", 1, 3)).otherwise(F.col("radii")).alias("radii"),
        F.when(kind == 2, first("angles", 8)).otherwise(F.col("angles")).alias("angles"),
        F.when(kind == 3, first("signs", 0)).when(kind == 4, F.slice("signs", 1, 3)).otherwise(F.col("signs")).alias("signs"),
    )
    return hurt.select("id", F.array_join(rules.turbo_code(D, 4, N_PROJECTIONS), ",").alias("broken"))


# ---------------------------------------------------------------- profiles and codebooks

_BITS = "CAST(ceil(log2(words)) AS BIGINT)"
_FNV = "list_reduce(list_transform(range(1, strlen(body) + 1), lambda i: CAST(ascii(substr(body, i, 1)) AS UHUGEINT)), lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


@plans.add(f"WITH p AS (SELECT DISTINCT p_size % 15 + 2 AS bits, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE '32' END AS projections FROM part), b AS (SELECT bits, projections, 'CodecProfileV1|angles|64|' || bits || '|' || projections || '|42|auto' AS body FROM p) SELECT CAST(bits AS BIGINT) AS bits, projections, 'fnv1a64:' || lower(lpad(to_hex(CAST({_FNV} AS UBIGINT)), 16, '0')) AS digest FROM b")
def profile_digest(spark, sf_dir):
    """64-bit FNV-1a over the fields of a profile, joined by bars."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 15 + 2).cast("bigint").alias("bits"), F.when(F.col("p_size") % 2 == 0, "none").otherwise("32").alias("projections")).distinct()
    body = F.concat_ws("|", F.lit("CodecProfileV1"), F.lit("angles"), F.lit(64), "bits", "projections", F.lit(42), F.lit("auto"))
    return p.select("bits", "projections", F.concat(F.lit("fnv1a64:"), pack.fnv_column()(body)).alias("digest"))


@plans.add("SELECT CAST(n AS BIGINT) AS n, round((n - 0.5::DOUBLE) / 32, 9) AS share, round(sqrt(1 - pow(1 - (n - 0.5::DOUBLE) / 32, 4 / 64::DOUBLE)), 9) AS radius_2, round((n - 0.5::DOUBLE) / 32, 6) AS share_4 FROM range(1, 33) t(n)")
def radius_law(spark, sf_dir):
    """Radii of codewords: closed for blocks of 2; for blocks of 4 the law's share below each radius, in closed form."""
    rows = [(n, (n - 0.5) / 32, C.radius_quantile(64, 2, n, 32), C.radius_quantile(64, 4, n, 32)) for n in range(1, 33)]
    t = spark.createDataFrame(rows, "n bigint, share double, radius_2 double, radius_4 double")
    b, x = C.beta_shape(64, 4), F.col("radius_4") * F.col("radius_4")
    return t.select("n", F.round("share", 9).alias("share"), F.round("radius_2", 9).alias("radius_2"), r6(1 - F.pow(1 - x, F.lit(b)) * (1 + b * x)).alias("share_4"))


_CENT = {4: C.gaussian_centroids(4)}
_LM = f"bl AS (SELECT id, b, list_transform(range(1, 5), lambda j: x[4*b+j]) AS s FROM (SELECT id, x, unnest(range(0, {D // 4})) AS b FROM v)), nm AS (SELECT id, b, s, sqrt(list_inner_product(s, s)) AS n FROM bl), lv AS (SELECT id, b, s, n, list_transform(s, lambda a: CASE WHEN n > 1e-10 THEN list_position(list_transform([{', '.join(f'{c}::DOUBLE' for c in _CENT[4])}], lambda c: round(abs(a / n - c), 9)), list_min(list_transform([{', '.join(f'{c}::DOUBLE' for c in _CENT[4])}], lambda c: round(abs(a / n - c), 9)))) - 1 ELSE 0 END) AS k FROM nm)"


@plans.add(f"WITH {_V}, {_LM} SELECT id, CAST(b AS BIGINT) AS block, round(n, 6) AS norm, CAST(list_sum(list_transform(range(1, 5), lambda j: k[j] * pow(4, j - 1))) AS BIGINT) AS levels FROM lv")
def lloyd_max_encode(spark, sf_dir):
    """Each block's norm and the nearest fixed centroid of every scaled value."""
    coded = vectors(spark, sf_dir).select("id", F.posexplode(C.scalar_blocks(F.col("x"), 4, 4)).alias("b", "c"))
    number = sum((F.col("c.levels")[j] * 4**j for j in range(1, 4)), F.col("c.levels")[0])
    return coded.select("id", F.col("b").cast("bigint").alias("block"), r6("c.norm").alias("norm"), number.cast("bigint").alias("levels"))


@plans.add(f"WITH {_V}, {_LM} SELECT id, round(sum(list_sum(list_transform(range(1, 5), lambda j: pow(s[j] - n * ([{', '.join(f'{c}::DOUBLE' for c in _CENT[4])}])[CAST(k[j] AS INTEGER) + 1], 2)))) / {D}, 6) AS mse FROM lv GROUP BY id")
def lloyd_max_decode(spark, sf_dir):
    x = F.col("x")
    return vectors(spark, sf_dir).select("id", r6(vec.mse(x, C.scalar_blocks_decode(C.scalar_blocks(x, 4, 4), 4))).alias("mse"))


@plans.add("SELECT CAST(32 AS BIGINT) AS words, CAST(4096 AS BIGINT) AS samples, true AS never_worse, true AS better")
def lloyd_refine(spark, sf_dir):
    """Training on samples of the radius law: never worse than the start, and here better."""
    drawn = lloyd.samples(spark, 4096, D, 4, 42)
    got = lloyd.refine(drawn, np.array(BOOK), iterations=4, restarts=2)
    n = drawn.agg(F.count("*").alias("samples"))
    return n.select(F.lit(len(got.book)).cast("bigint").alias("words"), "samples", F.lit(got.mse <= got.first_mse).alias("never_worse"), F.lit(got.mse < got.first_mse).alias("better"))


@plans.add(f"SELECT CAST(p_partkey AS BIGINT) AS id, CAST(words AS BIGINT) AS words, {_BITS} AS bits, round(p_size % 8 * 32 / ceil(log2(words)), 6) AS ratio, array_to_string(list_filter([CASE WHEN p_size % 8 < 1 OR p_size % 8 >= 64 THEN 'block' END, CASE WHEN p_size % 8 > 0 AND 64 % (p_size % 8) <> 0 THEN 'divisible' END, CASE WHEN p_size % 3 = 0 THEN 'index_bits' END, CASE WHEN p_size % 7 = 0 THEN 'restarts' END, CASE WHEN p_size % 11 = 0 THEN 'samples' END], lambda r: r IS NOT NULL), ',') AS broken FROM (SELECT *, p_size % 60 + 2 AS words FROM part)")
def fib_profiles(spark, sf_dir):
    """Nominal ratios of codebook profiles and the rules that they break."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    words = size % 60 + 2
    bits = F.length(F.bin((words - 1).cast("bigint")))
    t = p.select(
        F.col("p_partkey").cast("bigint").alias("id"), F.lit(64).alias("dim"), (size % 8).alias("block"), words.alias("words"), (bits + F.when(size % 3 == 0, 1).otherwise(0)).alias("index_bits"),
        F.lit("f16").alias("norm"), F.when(size % 7 == 0, 0).otherwise(4).alias("restarts"), F.lit(8).alias("iterations"), F.when(size % 11 == 0, words - 1).otherwise(F.lit(2048)).alias("samples"), bits.alias("bits"),
    )
    return t.select("id", F.col("words").cast("bigint").alias("words"), F.col("bits").cast("bigint").alias("bits"), r6(F.col("block") * 32 / F.col("bits")).alias("ratio"), F.array_join(rules.fib_profile(), ",").alias("broken"))
