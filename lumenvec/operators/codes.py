"""Tables of codes and of the blobs that hold them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import arrow_map, lists, matrix
from ..functions import quantize, wire
from ..functions.wire import FibProfile, TurboProfile


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def turbo_codes(df: DataFrame, profile: TurboProfile) -> DataFrame:
    """(id, radii, angles, signs) of (id, x)."""

    def rows(batch):
        radii, angles, signs = quantize.turbo(profile).encode(batch.column("x").to_pylist())
        return {"id": batch.column("id"), "radii": lists(radii), "angles": lists(angles), "signs": lists(signs)}

    return arrow_map(df.select("id", "x"), rows, f"id {_kind(df, 'id')}, radii array<double>, angles array<int>, signs array<int>")


def turbo_blobs(codes: DataFrame, profile: TurboProfile) -> DataFrame:
    """(id, blob): each code with a header of its own."""

    def rows(batch):
        parts = [matrix(batch.column(c)) for c in ("radii", "angles", "signs")]
        blobs = [wire.tqw1_encode(profile, r, k, s) for r, k, s in zip(parts[0], parts[1].astype(int), parts[2].astype(int), strict=True)]
        return {"id": batch.column("id"), "blob": pa.array(blobs, pa.binary())}

    return arrow_map(codes.select("id", "radii", "angles", "signs"), rows, f"id {_kind(codes, 'id')}, blob binary")


def turbo_of_blobs(blobs: DataFrame, profile: TurboProfile) -> DataFrame:
    """(id, radii, angles, signs): blobs read back and checked."""

    def rows(batch):
        parts = [wire.tqw1_decode(profile, b) for b in batch.column("blob").to_pylist()]
        return {"id": batch.column("id")} | {c: lists(np.stack([p[i] for p in parts])) for i, c in enumerate(("radii", "angles", "signs"))}

    return arrow_map(blobs.select("id", "blob"), rows, f"id {_kind(blobs, 'id')}, radii array<double>, angles array<int>, signs array<int>")


def headers_of_blobs(blobs: DataFrame) -> DataFrame:
    """(id, dim, angle_bits, projections, seed, pairs, payload, rotation) from the headers; only their bytes go to Python."""
    heads = blobs.select("id", F.expr("substring(blob, 1, 46)").alias("head"))
    fields = ("dim", "angle_bits", "projections", "seed", "pairs", "payload", "rotation")

    def rows(batch):
        found = [wire.tqw1_header(b) for b in batch.column("head").to_pylist()]
        return {"id": batch.column("id")} | {f: [h[f] for h in found] for f in fields}

    return arrow_map(heads, rows, f"id {_kind(blobs, 'id')}, dim int, angle_bits int, projections int, seed bigint, pairs int, payload bigint, rotation string")


def turbo_vectors(codes: DataFrame, profile: TurboProfile) -> DataFrame:
    """(id, x): decoded by the angles' part."""

    def rows(batch):
        return {"id": batch.column("id"), "x": lists(quantize.turbo(profile).decode(matrix(batch.column("radii")), matrix(batch.column("angles"))))}

    return arrow_map(codes.select("id", "radii", "angles"), rows, f"id {_kind(codes, 'id')}, x array<double>")


def turbo_search_vectors(codes: DataFrame, profile: TurboProfile, residual_norm: str | None = None) -> DataFrame:
    """(id, x): the estimate of an inner product is x times turbo_query_vectors.

    residual_norm names a column that scales the signs' part; one where absent.
    """
    by = np.sqrt(np.pi / 2) / max(1, profile.projections)

    def rows(batch):
        q = quantize.turbo(profile)
        z = q.rotated(matrix(batch.column("radii")), matrix(batch.column("angles")))
        scale = batch.column(residual_norm).to_numpy()[:, None] if residual_norm else 1.0
        return {"id": batch.column("id"), "x": lists(np.concatenate([z, matrix(batch.column("signs")) * by * scale], 1))}

    return arrow_map(codes, rows, f"id {_kind(codes, 'id')}, x array<double>")


def turbo_query_vectors(df: DataFrame, profile: TurboProfile) -> DataFrame:
    """(id, x): a query rotated and projected, once for all codes."""

    def rows(batch):
        q = quantize.turbo(profile)
        y = quantize.checked(batch.column("x").to_pylist(), profile.dim) @ q.turn.T
        return {"id": batch.column("id"), "x": lists(np.concatenate([y, y @ q.planes.T], 1))}

    return arrow_map(df.select("id", "x"), rows, f"id {_kind(df, 'id')}, x array<double>")


def fib_codes(df: DataFrame, profile: FibProfile) -> DataFrame:
    """(id, norm, words) of (id, x)."""

    def rows(batch):
        norms, words = quantize.fib(profile).encode(batch.column("x").to_pylist())
        return {"id": batch.column("id"), "norm": norms, "words": lists(words)}

    return arrow_map(df.select("id", "x"), rows, f"id {_kind(df, 'id')}, norm double, words array<int>")


def fib_vectors(codes: DataFrame, profile: FibProfile) -> DataFrame:
    """(id, x): codewords gathered, rotated back and scaled."""

    def rows(batch):
        return {"id": batch.column("id"), "x": lists(quantize.fib(profile).decode(batch.column("norm").to_numpy(), matrix(batch.column("words"), np.int64)))}

    return arrow_map(codes.select("id", "norm", "words"), rows, f"id {_kind(codes, 'id')}, x array<double>")


def fib_blobs(codes: DataFrame, profile: FibProfile) -> DataFrame:
    """(id, blob): each code with a header of its own."""

    def rows(batch):
        pairs = zip(batch.column("norm").to_pylist(), matrix(batch.column("words"), np.int64), strict=True)
        return {"id": batch.column("id"), "blob": pa.array([wire.fb1_encode(profile, n, w) for n, w in pairs], pa.binary())}

    return arrow_map(codes.select("id", "norm", "words"), rows, f"id {_kind(codes, 'id')}, blob binary")


def fib_of_blobs(blobs: DataFrame, profile: FibProfile) -> DataFrame:
    """(id, norm, words): blobs read back and checked; norms are those stored."""

    def rows(batch):
        parts = [wire.fb1_decode(profile, b) for b in batch.column("blob").to_pylist()]
        return {"id": batch.column("id"), "norm": [p[0] for p in parts], "words": lists(np.stack([p[1] for p in parts]))}

    return arrow_map(blobs.select("id", "blob"), rows, f"id {_kind(blobs, 'id')}, norm double, words array<int>")


def receipts(blobs: DataFrame, dim: int, x: DataFrame, back: DataFrame) -> DataFrame:
    """(id, encoded_bytes, fp16_bytes, fp32_bytes, ratio_fp16, ratio_fp32, source_digest, mse, cosine) of each code.

    x and back are (id, x): the vectors and what their codes decode to.
    """
    from ..functions import vec

    met = blobs.join(x, "id").join(back.select("id", F.col("x").alias("y")), "id")
    size, a, b = F.octet_length("blob"), F.col("x"), F.col("y")
    return met.select(
        "id", size.cast("bigint").alias("encoded_bytes"), F.lit(2 * dim).alias("fp16_bytes"), F.lit(4 * dim).alias("fp32_bytes"),
        (2 * dim / size).alias("ratio_fp16"), (4 * dim / size).alias("ratio_fp32"),
        F.sha2(F.to_json("x"), 256).alias("source_digest"), vec.mse(a, b).alias("mse"), vec.cosine(a, b).alias("cosine"),
    )
