"""Quality scores by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (lengths, character and
word shares, repetition).  Per class the moments of all labelled training rows
are summed in partitions and then by key, so the fit is a few hundred rows
whatever the corpus.  Class covariances shrink towards the pooled one and its
diagonal; the Cholesky factors are computed once and travel with the tasks.
A score is the difference of the two Mahalanobis log-densities plus the log
prior ratio, calibrated by a logistic curve fitted on a histogram of the
training rows' differences.

Edge cases: null and empty texts have a vector too and get a score; labels that
are null or of no known document are ignored; repeated labels count each; with
one class only, or none, every score is the smoothed share of label 1; scores
depend on nothing but the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, pick, slices

FEATURES = (
    "log_chars", "log_words", "word_mean", "word_sd", "upper", "digit", "symbol", "stop",
    "comma", "space", "newline", "non_ascii", "distinct", "top_word", "capital_words",
    "symbol_words", "long_words", "line_repeat", "line_mean", "entropy",
)
FOLDS = 5
THRESHOLD = 0.3
SHRINK_POOLED = 0.1
SHRINK_DIAGONAL = 0.1
_BINS = 4000

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()"]] = True
_SIGNS = re.compile(r"[^\w\s.,;:'\"?()-]")


def _share(n: float, of: float) -> float:
    """Angular transform of a share, smoothed so that short texts stay inside."""
    return math.asin(math.sqrt((n + 0.05) / (of + 0.1)))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n, w = len(raw), len(words)
    sizes = np.fromiter(map(len, words), np.int64, w) if w else np.zeros(1, np.int64)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = c[c > 0] / max(1, n)
    signs = len(_SIGNS.findall(text)) if c[_SYMBOLS].any() or n > len(text) else 0
    return [
        math.log1p(len(text)),
        math.log1p(w),
        math.log1p(float(sizes.mean())),
        math.log1p(float(sizes.std())),
        _share(c[65:91].sum(), n),
        _share(c[48:58].sum(), n),
        _share(c[_SYMBOLS].sum(), n),
        _share(c[46], n),
        _share(c[44], n),
        _share(c[32], n),
        _share(c[10], n),
        _share(c[128:].sum(), n),
        _share(len(counts), w),
        _share(max(counts.values(), default=0), w),
        _share(sum(k for x, k in counts.items() if x.isupper()), w),
        _share(min(signs, w), w),
        _share(int((sizes > 14).sum()), w),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(text) / max(1, len(lines))),
        float(-(share * np.log2(share)).sum()) if n else 0.0,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the vector of each document."""
    source = pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    rows = lambda cols: {"id": cols["id"], "x": [statistics(t) for t in cols["text"]]}
    return arrow_map(source, rows, f"id {kind}, x array<double>")


def fold(id_col: str = "id"):
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


@dataclass
class Model:
    """Means, inverse Cholesky factors, constants; a and b calibrate; prior serves where no fit is possible."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None
    a: float = 1.0
    b: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | 1) - log p(x | 0) + log prior ratio."""
        d = [
            self.constants[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1)
            for k in (0, 1)
        ]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = self.a * np.arcsinh(self.difference(x)) + self.b
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _moments(labelled: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of products by class, summed in partitions and then by key."""

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column("x"), d), batch.column("y").to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k in (0, 1):
            if total[k, 0]:
                n = total.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n) + k * n), pa.array(total[k])], ["i", "v"]
                )

    parts = labelled.mapInArrow(run, "i bigint, v double")
    got = np.zeros((2, 1 + d + d * d))
    for row in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # 2 (1 + d + d d) rows
        got.flat[row["i"]] = row["v"]
    return got[:, 0], got[:, 1 : 1 + d], got[:, 1 + d :].reshape(2, d, d)


def _calibrate(model: Model, labelled: DataFrame, d: int) -> None:
    """Fit a and b on a histogram of arcsinh(difference) over all training rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = np.arcsinh(model.difference(_matrix(batch.column("x"), d)))
                at = np.clip(np.round(z * 100), -_BINS, _BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["at", "y"])

    rows = labelled.mapInArrow(run, "at bigint, y int").groupBy("at", "y").agg(F.count("*").alias("n")).collect()
    z = np.array([r["at"] / 100 for r in rows])
    y = np.array([r["y"] for r in rows], float)
    n = np.array([r["n"] for r in rows], float)
    beta, x = np.array([1.0, 0.0]), np.stack([z, np.ones_like(z)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (n * (y - p)) - 1e-3 * beta)
        beta = beta + np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    if beta[0] > 0:
        model.a, model.b = map(float, beta)


def fit(
    vectors: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    held_out: bool = True,
) -> Model:
    """Fit on the labelled rows of ``vectors``; rows of fold 0 are left out if held_out."""
    y = pick(labels, id=id_col, y=label_col).where("y in (0, 1) and id is not null")
    if held_out:
        y = y.where(fold("id") != 0)
    labelled = vectors.join(y.select("id", F.col("y").cast("int").alias("y")), "id").select("x", "y")
    d = len(FEATURES)
    count, sums, products = _moments(labelled, d)
    model = Model(prior=float((count[1] + 1) / (count.sum() + 2)))
    if count.min() < 2:
        return model
    means = sums / count[:, None]
    own = [products[k] / count[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (own[0] * count[0] + own[1] * count[1]) / count.sum()
    diagonal = np.diag(np.diag(pooled) + 1e-6)
    target = (1 - SHRINK_DIAGONAL) * pooled + SHRINK_DIAGONAL * diagonal
    factors, constants = [], []
    for k in (0, 1):
        # few rows lean more on the pooled covariance
        lean = max(SHRINK_POOLED, d / (d + count[k]))
        cov = (1 - lean) * own[k] + lean * target + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(lower, np.eye(d)))
        constants.append(math.log(count[k] / count.sum()) - np.log(np.diag(lower)).sum())
    model.means, model.factors, model.constants = means, np.array(factors), np.array(constants)
    _calibrate(model, labelled, d)
    return model


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each vector."""
    d = len(FEATURES)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix(batch.column("x"), d))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], ["id", "score"])

    return vectors.mapInArrow(run, f"id {kind}, score double")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    vectors = Scratch(docs.sparkSession, "quality").store("vectors", features(docs, id_col, text_col))
    model = fit(vectors, labels, id_col, label_col)
    return score(vectors, model).select(
        F.col("id").alias(id_col),
        (fold("id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    The texts are scored where they are read; only ids and vectors of labelled
    rows meet, for the fit.
    """
    vectors = Scratch(docs.sparkSession, "quality").store("vectors", features(docs, id_col, text_col))
    model = fit(vectors, labels, id_col)
    d, at = len(FEATURES), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, d)
            keep = model.score(x) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
