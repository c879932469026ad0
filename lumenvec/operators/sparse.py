"""Sparse selection plans over score traces: five patterns, a comparison and a gate.

Scores come as rows (trace, pos, score).  All patterns are columns of one table:
a trace is sorted by score once, blocks are ranked in an aggregate, and caps,
masses and recalls are running sums over that one order.  A trace is a context
of bounded length, so its windows are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX, RECENT, VERTICAL, BLOCK, TOP_BLOCKS, MAX_TOKENS, MASS, TOP_K = 4, 8, 8, 16, 2, 32, 0.9, 8
GATE = {"recall": 0.8, "mass": 0.8, "saved": 0.3}
PATTERNS = ("ashape", "vertical", "block", "hybrid", "adaptive")


def _in_ends() -> Column:
    return (F.col("pos") < PREFIX) | (F.col("pos") >= F.col("n") - RECENT)


def weighed(scored: DataFrame) -> DataFrame:
    """(trace, pos, score, n, e, p, r, blk): length, softmax weight and share, rank by score from 0, block."""
    one = Window.partitionBy("trace")
    w = scored.withColumns({"top": F.max("score").over(one), "n": F.count("*").over(one)}).withColumn("e", F.exp(F.col("score") - F.col("top")))
    w = w.withColumns({"p": F.col("e") / F.sum("e").over(one), "r": F.row_number().over(one.orderBy(F.desc("score"), "pos")) - 1})
    return w.withColumn("blk", F.floor(F.col("pos") / BLOCK)).drop("top")


def _block_ranks(w: DataFrame) -> DataFrame:
    """(trace, blk, order, order_rest): blocks by their mass, and by the mass of what ends and verticals leave."""
    rest = ~(_in_ends() | (F.col("r") < VERTICAL))
    mass = w.groupBy("trace", "blk").agg(F.round(F.sum("e"), 9).alias("m"), F.round(F.sum(F.when(rest, F.col("e"))), 9).alias("m_rest"))
    by = lambda c: F.row_number().over(Window.partitionBy("trace").orderBy(F.desc_nulls_last(c), "blk"))
    ranked = mass.select("trace", "blk", by("m").alias("order"), F.when(F.col("m_rest").isNotNull(), by("m_rest")).alias("order_rest"))
    return ranked


def plans(scored: DataFrame) -> DataFrame:
    """weighed rows with a boolean column per pattern: whether the position is read."""
    w = weighed(scored)
    w = w.join(_block_ranks(w), ["trace", "blk"])
    ranks = Window.partitionBy("trace").orderBy("r")
    before = F.coalesce(F.sum("p").over(ranks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    wanted = {
        "ashape": _in_ends(),
        "vertical": (F.col("r") < VERTICAL) | (F.col("pos") >= F.col("n") - RECENT),
        "block": F.col("order") <= TOP_BLOCKS,
        "hybrid": _in_ends() | (F.col("r") < VERTICAL) | F.coalesce(F.col("order_rest") <= TOP_BLOCKS, F.lit(False)),
        "adaptive": (F.col("r") < MAX_TOKENS) & ((F.col("r") < TOP_K) | (F.round(before, 9) < MASS)),
    }
    w = w.withColumns(wanted)
    # the cap keeps the best scores: the first MAX_TOKENS wanted ones in the order of ranks
    capped = {p: F.col(p) & (F.sum(F.col(p).cast("int")).over(ranks) <= MAX_TOKENS) for p in PATTERNS}
    return w.withColumns(capped)


def select(scored: DataFrame, pattern: str) -> DataFrame:
    """(trace, pos) that a pattern reads."""
    return plans(scored).where(F.col(pattern)).select("trace", "pos")


def compare(scored: DataFrame) -> DataFrame:
    """(pattern, trace, reads, recall, mass, saved): all patterns from one aggregate per trace."""
    w = plans(scored)
    sums = {}
    for p in PATTERNS:
        read = F.col(p)
        sums[p] = F.struct(
            F.lit(p).alias("pattern"), F.count_if(read).alias("reads"),
            F.round(F.count_if(read & (F.col("r") < TOP_K)) / F.least(F.lit(TOP_K), F.max("n")), 6).alias("recall"),
            F.round(F.sum(F.when(read, F.col("p")).otherwise(0.0)), 6).alias("mass"), F.round(1 - F.count_if(read) / F.max("n"), 6).alias("saved"),
        ).alias(p)
    rows = w.groupBy("trace").agg(*sums.values()).select("trace", F.explode(F.array(*PATTERNS)).alias("c"))
    return rows.select("c.pattern", "trace", "c.reads", "c.recall", "c.mass", "c.saved")


def summarise(scored: DataFrame) -> DataFrame:
    """(pattern, traces, passed, mean_recall, least_recall, mean_mass, mean_saved, candidate): the gate over all traces."""
    c = compare(scored)
    passes = (F.col("recall") >= GATE["recall"]) & (F.col("mass") >= GATE["mass"]) & (F.col("saved") >= GATE["saved"])
    return c.groupBy("pattern").agg(
        F.count("*").alias("traces"), F.count_if(passes).alias("passed"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.min("recall"), 6).alias("least_recall"),
        F.round(F.avg("mass"), 6).alias("mean_mass"), F.round(F.avg("saved"), 6).alias("mean_saved"), F.bool_and(passes).alias("candidate"),
    )
