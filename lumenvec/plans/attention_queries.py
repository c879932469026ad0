"""Attention-style queries: keys and values are the embeddings of a label, the query its first vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rotation import lcg_signs
from ..operators import sparse
from ..sources.tables import table, vectors
from . import sparse_sql
from .common import Plans
from .vector_queries import _CODES, D, _V, decoded, r6, unrotate

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles

_QK = "fq AS (SELECT label, min(id) AS qid FROM {0} GROUP BY label), lg AS (SELECT k.label, k.id, round(list_inner_product(q.x, k.x) / 8, 9) AS logit, k.x FROM {0} k JOIN fq ON fq.label = k.label JOIN {0} q ON q.id = fq.qid)"
_SM = ", mx AS (SELECT label, max(logit) AS top FROM lg GROUP BY label), sm AS (SELECT lg.label, lg.id, lg.logit, lg.x, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY lg.label) AS p FROM lg JOIN mx ON mx.label = lg.label)"
_LG = f"WITH {_V}, " + _QK.format("v")


def logits(v: DataFrame) -> DataFrame:
    """(label, id, x, logit): scaled dot products with the label's query."""
    first = v.groupBy("label").agg(F.min_by("x", "id").alias("q"))
    return v.join(first, "label").select("label", "id", "x", F.round(vec.dot(F.col("q"), F.col("x")) / D**0.5, 9).alias("logit"))


def softmax(rows: DataFrame) -> DataFrame:
    """rows with p: two aggregates per label instead of a window over its rows."""
    top = rows.groupBy("label").agg(F.max("logit").alias("top"))
    e = rows.join(top, "label").withColumn("e", F.exp(F.col("logit") - F.col("top")))
    total = e.groupBy("label").agg(F.sum("e").alias("total"))
    return e.join(total, "label").withColumn("p", F.col("e") / F.col("total")).drop("e", "top", "total")


@plans.add(_LG + " SELECT CAST(label AS BIGINT) AS label, id, round(logit, 6) AS logit FROM lg")
def attention_logits(spark, sf_dir):
    return logits(vectors(spark, sf_dir)).select(F.col("label").cast("bigint").alias("label"), "id", r6("logit").alias("logit"))


@plans.add(_LG + _SM + " SELECT CAST(label AS BIGINT) AS label, id, round(p, 6) AS p FROM sm")
def attention_softmax(spark, sf_dir):
    return softmax(logits(vectors(spark, sf_dir))).select(F.col("label").cast("bigint").alias("label"), "id", r6("p").alias("p"))


@plans.add(_LG + _SM + f" SELECT CAST(label AS BIGINT) AS label, CAST(d AS BIGINT) AS dim, round(sum(p * x[d+1]), 6) AS value FROM (SELECT label, p, x, unnest(range(0, {D})) AS d FROM sm) GROUP BY label, d")
def attend(spark, sf_dir):
    """Weighted sum of the vectors of a label, a row per dimension; partial sums on the map side."""
    s = softmax(logits(vectors(spark, sf_dir))).select("label", "p", F.posexplode("x").alias("d", "c"))
    return s.groupBy(F.col("label").cast("bigint").alias("label"), F.col("d").cast("bigint").alias("dim")).agg(r6(F.sum(F.col("p") * F.col("c"))).alias("value"))


_UN = f", un AS (SELECT id, label, x, list_transform(range(0, {D}), lambda j: list_sum(list_transform(range(0, {D}), lambda i: z[i+1] * (1 - 2 * (bit_count(i & j) % 2)))) / 8) AS h FROM dec)"
_SIGN = lcg_signs(D)
_UNS = _UN + f", back AS (SELECT id, label, x AS x0, list_transform(range(1, {D + 1}), lambda i: h[i] * ([{','.join(f'{float(s)}::DOUBLE' for s in _SIGN)}])[i]) AS y0 FROM un)"
_PAIR = (
    _CODES + _UNS
    + ", fq AS (SELECT label, min(id) AS qid FROM back GROUP BY label), lg AS (SELECT k.label, k.id, round(list_inner_product(q.x0, k.x0) / 8, 9) AS a, round(list_inner_product(q.x0, k.y0) / 8, 9) AS b FROM back k JOIN fq ON fq.label = k.label JOIN back q ON q.id = fq.qid)"
)


def _exact_and_coded(spark, sf_dir) -> DataFrame:
    """(label, id, a, b): logits from the vectors and from their codes."""
    d = decoded(spark, sf_dir).select("label", "id", "x", unrotate("z", D).alias("back"))
    first = d.groupBy("label").agg(F.min_by("x", "id").alias("q"))
    logit = lambda c: F.round(vec.dot(F.col("q"), F.col(c)) / D**0.5, 9)
    return d.join(first, "label").select("label", "id", logit("x").alias("a"), logit("back").alias("b"))


@plans.add(_PAIR + " SELECT CAST(label AS BIGINT) AS label, id, round(a, 6) AS exact, round(b, 6) AS coded, round(abs(a - b), 6) AS error FROM lg")
def shadow_scores(spark, sf_dir):
    s = _exact_and_coded(spark, sf_dir)
    return s.select(F.col("label").cast("bigint").alias("label"), "id", r6("a").alias("exact"), r6("b").alias("coded"), r6(F.abs(F.col("a") - F.col("b"))).alias("error"))


@plans.add(_PAIR + ", mx AS (SELECT label, max(a) AS ma, max(b) AS mb FROM lg GROUP BY label), sm AS (SELECT lg.label, a, b, exp(a - ma) / sum(exp(a - ma)) OVER (PARTITION BY lg.label) AS p, exp(b - mb) / sum(exp(b - mb)) OVER (PARTITION BY lg.label) AS q FROM lg JOIN mx ON mx.label = lg.label) SELECT CAST(label AS BIGINT) AS label, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(sum(abs(p - q)) / 2, 6) AS total_variation, round(sum(p * ln((p + 1e-12) / (q + 1e-12))), 6) AS kl FROM sm GROUP BY label")
def attention_quality(spark, sf_dir):
    s = _exact_and_coded(spark, sf_dir)
    p = softmax(s.withColumn("logit", F.col("a"))).select("label", "id", "a", "b", "p")
    q = softmax(s.withColumn("logit", F.col("b"))).select("label", "id", F.col("p").alias("q"))
    met = p.join(q, ["label", "id"])
    gap = F.col("a") - F.col("b")
    return met.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        r6(F.sqrt(F.avg(gap * gap))).alias("rmse"), r6(F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"),
        r6(F.sum(F.col("p") * F.log((F.col("p") + 1e-12) / (F.col("q") + 1e-12)))).alias("kl"),
    )


@plans.add(_PAIR + ", m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a DESC, id) AS ra, row_number() OVER (PARTITION BY label ORDER BY b DESC, id) AS rb FROM lg) SELECT CAST(label AS BIGINT) AS label, round(max(abs(a - b)), 6) AS max_abs, round(max(abs(a - b) / greatest(abs(a), 1e-6)), 3) AS max_rel, CAST(sum(CASE WHEN ra <= 5 AND rb <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS top5, max(CASE WHEN ra = 1 THEN id END) = max(CASE WHEN rb = 1 THEN id END) AS same_best FROM m GROUP BY label")
def logit_metrics(spark, sf_dir):
    s = _exact_and_coded(spark, sf_dir)
    w = Window.partitionBy("label")
    m = s.withColumns({"ra": F.row_number().over(w.orderBy(F.desc("a"), "id")), "rb": F.row_number().over(w.orderBy(F.desc("b"), "id"))})
    gap = F.abs(F.col("a") - F.col("b"))
    best = lambda c: F.max(F.when(F.col(c) == 1, F.col("id")))
    return m.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        r6(F.max(gap)).alias("max_abs"), F.round(F.max(gap / F.greatest(F.abs("a"), F.lit(1e-6))), 3).alias("max_rel"),
        F.count_if((F.col("ra") <= 5) & (F.col("rb") <= 5)).alias("top5"), (best("ra") == best("rb")).alias("same_best"),
    )


@plans.add(_PAIR + ", s AS (SELECT label, a - avg(a) OVER (PARTITION BY label) AS gap FROM lg) SELECT CAST(label AS BIGINT) AS label, round(greatest(10 * max(abs(gap)), 1e-6), 6) AS tolerance FROM s GROUP BY label")
def freeze_tolerance(spark, sf_dir):
    """Ten times the largest deviation from the mean, floored."""
    s = _exact_and_coded(spark, sf_dir)
    # the largest deviation is at an end, so one aggregate is enough
    ends = s.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.avg("a").alias("m"), F.max("a").alias("hi"), F.min("a").alias("lo"))
    far = F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo"))
    return ends.select("label", r6(F.greatest(10 * far, F.lit(1e-6))).alias("tolerance"))


# ---------------------------------------------------------------- sparse plans

_TRACE = "scored AS (SELECT CAST(label AS BIGINT) AS trace, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS pos, round(logit * 40, 6) AS score FROM lg)"
_SCORED = f"{_LG}, {_TRACE}, "


def scored(spark, sf_dir) -> DataFrame:
    """A trace per label: its logits in the order of ids."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    return logits(vectors(spark, sf_dir)).select(F.col("label").cast("bigint").alias("trace"), at.alias("pos"), F.round(F.col("logit") * 40, 6).alias("score"))


def _pattern(name: str):
    def query(spark, sf_dir):
        return sparse.select(scored(spark, sf_dir), name).select("trace", F.col("pos").cast("bigint").alias("pos"))

    query.__name__ = f"sparse_{name}"
    plans.add(_SCORED + sparse_sql.BASE.lstrip() + ", " + sparse_sql.chosen(name) + " SELECT trace, CAST(pos AS BIGINT) AS pos FROM sel")(query)


for _name in sparse.PATTERNS:
    _pattern(_name)


@plans.add(_SCORED + sparse_sql.COMPARE.lstrip() + " SELECT pattern, trace, CAST(reads AS BIGINT) AS reads, CAST(recall AS DOUBLE) AS recall, CAST(mass AS DOUBLE) AS mass, CAST(saved AS DOUBLE) AS saved FROM cmp")
def sparse_compare(spark, sf_dir):
    return sparse.compare(scored(spark, sf_dir))


@plans.add(f"SELECT pattern, traces, CAST(passed AS BIGINT) AS passed, mean_recall, least_recall, mean_mass, mean_saved, candidate FROM ({_SCORED}{sparse_sql.SUMMARY.lstrip()})")
def sparse_gate_summary(spark, sf_dir):
    return sparse.summarise(scored(spark, sf_dir))


_LAST = 0.25


@plans.add(f"WITH n AS (SELECT user_id, event_id, abs(value) / 100 AS nll, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, count(*) AS tokens, round(exp(least(avg(nll), 50)), 4) AS ppl FROM n WHERE r > n - greatest(1, floor(n * {_LAST})) GROUP BY user_id")
def windowed_ppl(spark, sf_dir):
    """exp of the mean loss over the last quarter of each user's positions."""
    w = Window.partitionBy("user_id")
    n = table(spark, sf_dir, "events").select("user_id", (F.abs("value") / 100).alias("nll"), F.row_number().over(w.orderBy("event_id")).alias("r"), F.count("*").over(w).alias("n"))
    last = n.where(F.col("r") > F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * _LAST)))
    return last.groupBy("user_id").agg(F.count("*").alias("tokens"), F.round(F.exp(F.least(F.avg("nll"), F.lit(50.0))), 4).alias("ppl"))
