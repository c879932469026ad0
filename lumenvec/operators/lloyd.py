"""Codebook training on a table of samples: assignment and sums in the tasks, one row per codeword to the driver.

The codebook is the only thing that travels, words x block numbers either way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map, lists, matrix, slices
from ..functions.codecs import spherical_samples
from ..functions.rotation import qr_rotation

#: Empty cells take half of the most distorted one, this far apart.
SPLIT = 1e-4


@dataclass
class Trained:
    book: np.ndarray
    first_mse: float
    mse: float
    restart: int  # -1 if no restart was better than the start
    repairs: int


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance); the least index wins ties."""
    d = ((x[:, None, :] - book) ** 2).sum(2)
    at = d.argmin(1)
    return at, d[np.arange(len(at)), at]


def samples(spark: SparkSession, n: int, dim: int, k: int, seed: int, parts: int = 8) -> DataFrame:
    """(x): blocks of random unit vectors; each part draws its own."""
    share = -(-n // parts)

    def draw(batch):
        out = [spherical_samples(min(share, n - p * share), dim, k, seed + p) for p in batch.column("id").to_pylist() if p * share < n]
        return {"x": lists(np.concatenate(out) if out else np.empty((0, k)))}

    return arrow_map(spark.range(0, parts, 1, parts), draw, "x array<double>")


def cells(rows: DataFrame, book: np.ndarray) -> dict[int, tuple]:
    """word -> (count, distortion, sums, farthest distance, farthest sample) of (x)."""
    k = book.shape[1]

    def run(batches):
        for batch in slices(batches):
            x = matrix(batch.column("x"))
            at, d = nearest(x, book)
            words = np.unique(at)
            own = [np.flatnonzero(at == w) for w in words]
            far = [o[d[o].argmax()] for o in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.astype(np.int64)), pa.array([len(o) for o in own], pa.int64()), pa.array([d[o].sum() for o in own]),
                 lists(np.stack([x[o].sum(0) for o in own])), pa.array(d[far]), lists(x[far])],
                ["word", "n", "distortion", "sums", "far", "sample"],
            )

    parts = rows.select("x").mapInArrow(run, "word bigint, n bigint, distortion double, sums array<double>, far double, sample array<double>")
    sums = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(k)]
    found = parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("distortion").alias("distortion"), *sums, F.max(F.struct("far", "sample")).alias("f")).collect()
    return {r["word"]: (r["n"], r["distortion"], np.array([r[f"s{j}"] for j in range(k)]), r["f"]["far"], np.array(r["f"]["sample"])) for r in found}


def mse(found: dict[int, tuple], k: int) -> float:
    return sum(c[1] for c in found.values()) / (sum(c[0] for c in found.values()) * k)


def step(book: np.ndarray, found: dict[int, tuple], repair: bool = True) -> tuple[np.ndarray, int]:
    """The centroids, and how many empty cells were repaired."""
    new, count = book.copy(), {w: c[0] for w, c in found.items()}
    distortion = {w: c[1] for w, c in found.items()}
    for w, c in found.items():
        new[w] = c[2] / c[0]
    empty = [w for w in range(len(book)) if w not in found]
    if empty and not repair:
        raise ValueError(f"{len(empty)} cells are empty")
    for w in empty:
        donors = [d for d in sorted(count) if count[d] > 1]
        if not donors:
            raise ValueError("no cell can give to an empty one")
        donor = max(donors, key=lambda d: (distortion[d], d))
        way = found[donor][4] - new[donor] if donor in found else np.zeros(book.shape[1])
        size = np.linalg.norm(way)
        if not size > np.finfo(float).eps:
            raise ValueError("a cell to split has no direction")
        new[donor], new[w] = new[donor] - SPLIT * way / size, new[donor] + SPLIT * way / size
        count[donor], count[w], distortion[donor], distortion[w] = count[donor] - 1, 1, 0.0, 0.0
    return new, len(empty)


def refine(rows: DataFrame, book: np.ndarray, iterations: int = 8, restarts: int = 4, seed: int = 42) -> Trained:
    """The best codebook of some restarts, never worse than the start; rows as (x).

    Restart 0 begins at the start codebook, others at rotations of it.
    """
    book = np.asarray(book, np.float64)
    k = book.shape[1]
    best = Trained(book, first := mse(cells(rows, book), k), first, -1, 0)
    for restart in range(restarts):
        own = book if not restart else book @ qr_rotation(k, seed + restart).T
        for _ in range(iterations):
            own, repaired = step(own, cells(rows, own))
            best.repairs += repaired
        found = mse(cells(rows, own), k)
        if found < best.mse:
            best.book, best.mse, best.restart = own, found, restart
    return best
