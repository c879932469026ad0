"""Top-k search: a stated query set against all rows.

Rows are dealt into parts of bounded size and every query visits every part:
one shuffle of the rows, and a copy of the queries per part.  A task holds one
part as a matrix, streams the queries past it in blocks and keeps the k best
of each.  No query comes to the driver, and one plan serves any number of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import matrix, slices

#: Rows of a part, at most about; and, of a small table, at least about.
PART_ROWS, LEAST_ROWS = 65_536, 4_096
#: Queries that are multiplied with a part at once, at most; and the scores that this makes, at most about (32 MB, a few of them at a time).
BLOCK, SCORES = 1024, 1 << 22
#: Parts whose results are ranked together.
FAN = 1024


def part_count(rows: int, cores: int) -> int:
    """Parts that bound their rows, and enough of them for the cores where the table is small."""
    return max(1, -(-rows // PART_ROWS), min(cores, -(-rows // LEAST_ROWS)))


def block_rows(rows: int, block: int = BLOCK) -> int:
    """Queries of a block against so many rows: their scores stay bounded."""
    return max(1, min(block, SCORES // max(1, rows)))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    s = q @ x.T
    if metric == "cosine":
        s /= np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    elif metric == "l2":
        s = -np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * s))
    return s.round(9)


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, by score and then id; ids ascend."""
    n = s.shape[1]
    if n > 4 * k:
        # all that reach the k-th score may be among the best
        edge = np.partition(s, n - k, axis=1)[:, n - k]
        return np.stack([(c := np.flatnonzero(row >= e))[np.argsort(-row[c], kind="stable")[:k]] for row, e in zip(s, edge, strict=True)])
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def _visit(batches, k: int, metric: str, block: int):
    """A task's batches, ordered by part, rows before queries: (part, q, id, score) of the k best rows of a part for each query."""
    part, held, ids, x = -1, [], None, None
    for batch in slices(batches):
        parts_, sides = batch.column("part").to_numpy(), batch.column("side").to_numpy()
        change = np.flatnonzero((np.diff(parts_) != 0) | (np.diff(sides) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(sides)], strict=True):
            piece = batch.slice(a, b - a)
            if parts_[a] != part:
                part, held, ids, x = parts_[a], [], None, None
            if sides[a] == 0:
                held.append(piece)
                continue
            if not held and ids is None:  # no rows in this part
                continue
            if ids is None:
                ids = np.concatenate([h.column("id").to_numpy() for h in held])
                x, held = np.concatenate([matrix(h.column("x")) for h in held]), []
            step = block_rows(len(ids), block)
            for at in range(0, b - a, step):
                some = piece.slice(at, step)
                s = _scores(matrix(some.column("x")), x, metric)
                best = _best(s, ids, min(k, len(ids)))
                q = np.repeat(some.column("id").to_numpy(), best.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), part, np.int32)), pa.array(q), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(s, best, 1).ravel())], ["part", "q", "id", "score"]
                )


def top_k(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "ip", block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """(q, id, score, rank): rank from 0 by score, then id; score is minus the distance for l2.

    rows is the size of the corpus where the caller knows it; it is counted else.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = corpus.sparkSession
    parts = part_count(corpus.select("id").count() if rows is None else rows, spark.sparkContext.defaultParallelism)
    own = corpus.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), "id", F.col("x").cast("array<double>").alias("x"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("side"), "id", F.col("x").cast("array<double>").alias("x"))
    dealt = own.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "side", "id")

    found = dealt.mapInArrow(lambda batches: _visit(batches, k, metric, block), "part int, q bigint, id bigint, score double")
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")) - 1).where(F.col("rank") < k)
    if parts > FAN:
        found = ranked(found.withColumn("fan", F.floor(F.col("part") / FAN)), "q", "fan").drop("rank")
    return ranked(found, "q").select("q", "id", "score", "rank")


def candidates(k: int, oversample: int) -> int:
    if k < 1:
        raise ValueError("k must be positive")
    return k * max(oversample, 1)


def rerank(found: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact inner products of the candidates, ranked again."""
    from ..functions.vec import dot

    pairs = found.select("q", "id").join(corpus.select("id", "x"), "id").join(queries.select(F.col("id").alias("q"), F.col("x").alias("y")), "q")
    scored = pairs.select("q", "id", F.round(dot(F.col("x"), F.col("y")), 9).alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(hits, expected, recall), micro-averaged."""
    hits = exact.select("q", "id").join(found.select("q", "id").withColumn("hit", F.lit(1)), ["q", "id"], "left")
    got = hits.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("expected"))
    return got.withColumn("recall", F.coalesce(F.try_divide("hits", "expected"), F.lit(0.0)))
