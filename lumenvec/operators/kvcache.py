"""Attention over a cache of coded keys and values: scores, softmax and sums on the codes.

A cache is a table (ctx, pos, key and value codes[, key, value]); a context is
a query's cache.  Scores are a row per position, sums have map-side partials.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import arrow_map, lists, matrix
from ..functions import quantize
from ..functions.vec import dot
from ..functions.wire import TurboProfile

#: Values are rotated by another seed than keys, so that their errors are unrelated.
VALUE_SEED_STEP = 1


def profiles(profile: TurboProfile) -> tuple[TurboProfile, TurboProfile]:
    from dataclasses import replace

    return profile, replace(profile, seed=profile.seed + VALUE_SEED_STEP)


def compress(tokens: DataFrame, profile: TurboProfile, keep_shadow: bool = True) -> DataFrame:
    """The cache of (ctx, pos, key, value); keep_shadow keeps the vectors as well."""
    own = profiles(profile)

    def rows(batch):
        out = {c: batch.column(c) for c in ("ctx", "pos")}
        for name, p in zip(("key", "value"), own, strict=True):
            radii, angles, signs = quantize.turbo(p).encode(batch.column(name).to_pylist())
            out |= {f"{name}_radii": lists(radii), f"{name}_angles": lists(angles), f"{name}_signs": lists(signs)}
            if keep_shadow:
                out[name] = batch.column(name)
        return out

    kind = lambda c: tokens.schema[c].dataType.simpleString()
    schema = f"ctx {kind('ctx')}, pos {kind('pos')}" + "".join(f", {n}_radii array<double>, {n}_angles array<int>, {n}_signs array<int>" for n in ("key", "value"))
    if keep_shadow:
        schema += ", key array<double>, value array<double>"
    return arrow_map(tokens.select("ctx", "pos", "key", "value"), rows, schema)


def scale_of(scale: str | float, dim: int) -> float:
    """none, head_dim, or a number of one's own."""
    by = {"none": 1.0, "head_dim": 1 / math.sqrt(dim)}.get(scale, scale)
    if not isinstance(by, (int, float)) or not math.isfinite(by):
        raise ValueError("a scale has to be a finite number")
    return float(by)


def scores(cache: DataFrame, queries: DataFrame, profile: TurboProfile, scale: str | float = "none") -> DataFrame:
    """(ctx, pos, score[, exact]) of each position for its context's query; queries as (ctx, q), one each.

    exact stands beside the estimate where the cache keeps its vectors.
    """
    by = scale_of(scale, profile.dim)
    q = quantize.turbo(profile)
    met = cache.join(queries.select("ctx", "q"), "ctx")
    shadow = "key" in cache.columns
    kept = met.select("ctx", "pos", "key_radii", "key_angles", "key_signs", "q", *["key"] * shadow)

    def rows(batch):
        query = matrix(batch.column("q"))
        y = query @ q.turn.T
        z = q.rotated(matrix(batch.column("key_radii")), matrix(batch.column("key_angles")))
        found = (y * z).sum(1)
        if profile.projections:
            found = found + math.sqrt(math.pi / 2) / profile.projections * ((y @ q.planes.T) * matrix(batch.column("key_signs"))).sum(1)
        out = {"ctx": batch.column("ctx"), "pos": batch.column("pos"), "score": (found * by).round(9)}
        return out | ({"exact": ((query * matrix(batch.column("key"))).sum(1) * by).round(9)} if shadow else {})

    kind = lambda c: cache.schema[c].dataType.simpleString()
    return arrow_map(kept, rows, f"ctx {kind('ctx')}, pos {kind('pos')}, score double" + ", exact double" * shadow)


def softmax(rows: DataFrame, score: str = "score") -> DataFrame:
    """rows with p, by two aggregates per context."""
    top = rows.groupBy("ctx").agg(F.max(score).alias("__top"))
    e = rows.join(top, "ctx").withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    total = e.groupBy("ctx").agg(F.sum("__e").alias("__total"))
    return e.join(total, "ctx").withColumn("p", F.col("__e") / F.col("__total")).drop("__e", "__top", "__total")


def values(cache: DataFrame, profile: TurboProfile, wanted: DataFrame | None = None) -> DataFrame:
    """(ctx, pos, value): values decoded from their codes; wanted as (ctx, pos) selects positions."""
    own = profiles(profile)[1]
    source = cache if wanted is None else cache.join(wanted.select("ctx", "pos").distinct(), ["ctx", "pos"], "left_semi")

    def rows(batch):
        back = quantize.turbo(own).decode(matrix(batch.column("value_radii")), matrix(batch.column("value_angles")))
        return {"ctx": batch.column("ctx"), "pos": batch.column("pos"), "value": lists(back)}

    kind = lambda c: cache.schema[c].dataType.simpleString()
    return arrow_map(source.select("ctx", "pos", "value_radii", "value_angles"), rows, f"ctx {kind('ctx')}, pos {kind('pos')}, value array<double>")


def attend(cache: DataFrame, queries: DataFrame, profile: TurboProfile, scale: str | float = "none") -> DataFrame:
    """(ctx, dim, value): softmax of the scores times the decoded values; zeros for a context without positions."""
    weights = softmax(scores(cache, queries, profile, scale)).select("ctx", "pos", "p")
    met = weights.join(values(cache, profile), ["ctx", "pos"]).select("ctx", "p", F.posexplode("value").alias("dim", "v"))
    sums = met.groupBy("ctx", "dim").agg(F.sum(F.col("p") * F.col("v")).alias("value"))
    grid = queries.select("ctx", F.explode(F.sequence(F.lit(0), F.lit(profile.dim - 1))).alias("dim"))
    return grid.join(sums, ["ctx", "dim"], "left").na.fill(0.0, ["value"])


def memory_report(cache: DataFrame, profile: TurboProfile) -> DataFrame:
    """One row of byte counts: codes, exact shadows, baselines."""
    shadow = "key" in cache.columns
    row = profile.row_bytes()
    n = F.count("*")
    raw = n * 2 * profile.dim * 4
    exact = (n if shadow else F.lit(0)) * profile.dim * 4
    return cache.agg(
        n.alias("tokens"), (n * row).alias("key_bytes"), (n * row).alias("value_bytes"), exact.alias("shadow_key_bytes"), exact.alias("shadow_value_bytes"),
        raw.alias("raw_bytes"), (n * 2 * profile.dim * 2).alias("fp16_bytes"), (n * row * 2 + exact * 2).alias("resident_bytes"), (n * row * 2).alias("sidecar_bytes"),
        F.when(n == 0, 0.0).otherwise(raw / (n * row * 2)).alias("ratio"),
    )


def nll(logits: Column, target: Column) -> Column:
    """Loss of a target index: log of the sum of exponentials less the target's logit."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return top + F.log(total) - F.get(logits, target)


def query_positions(length: Column, start: float, count: int) -> Column:
    """Positions spread evenly over the tail of a sequence, its last one included."""
    if count < 1:
        return F.array().cast("array<int>")
    last = length - 1
    begin = F.greatest(F.lit(1), F.least(last, F.floor(length * start)))
    span = last - begin
    steps = F.transform(F.sequence(F.lit(0), F.lit(max(0, count - 1))), lambda i: begin + F.bround(span * i / max(1, count - 1)))
    spread = F.when((span <= 0) | F.lit(count == 1), F.array(last)).otherwise(F.array_union(steps.cast("array<bigint>"), F.array(last.cast("bigint"))).cast("array<bigint>"))
    return F.when(length <= 1, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(spread.cast("array<bigint>"))))


def estimate_errors(found: DataFrame) -> DataFrame:
    """(ctx, pos, exact, score, error) of scores that have both."""
    return found.select("ctx", "pos", "exact", "score", F.abs(F.col("exact") - F.col("score")).alias("error"))


def exact_scores(cache: DataFrame, queries: DataFrame, scale: float = 1.0) -> DataFrame:
    """(ctx, pos, score) from the kept vectors."""
    if "key" not in cache.columns:
        raise ValueError("the cache keeps no vectors")
    return cache.join(queries.select("ctx", "q"), "ctx").select("ctx", "pos", F.round(dot(F.col("q"), F.col("key")) * scale, 9).alias("score"))


def agreement(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Share of the k best that two score rows have in common."""
    best = [set(np.lexsort((np.arange(len(x)), -x))[:k].tolist()) for x in (a, b)]
    return len(best[0] & best[1]) / k
