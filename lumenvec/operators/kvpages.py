"""A tensor of keys or values in pages of tokens, each vector a block: coded, or raw where it has to stay exact.

Rows are (batch, layer, head, token, x).  A block's number within its page
follows from its place, so no page has to be gathered to number its blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import arrow_map, lists
from ..functions import quantize, wire
from ..functions.rules import violations

AXES = ("raw", "per_token", "per_channel", "role_aware")


@dataclass(frozen=True)
class TensorShape:
    batch: int
    layers: int
    heads: int
    tokens: int
    head_dim: int


@dataclass(frozen=True)
class Protected:
    """What stays raw: first and last tokens, layers, heads."""

    first: int = 0
    last: int = 0
    layers: tuple[int, ...] = ()
    heads: tuple[int, ...] = ()

    def holds(self, shape: TensorShape, layer: Column, head: Column, token: Column) -> Column:
        return (token < self.first) | (token + self.last >= shape.tokens) | layer.isin(*self.layers) | head.isin(*self.heads)


@dataclass(frozen=True)
class PageProfile:
    tokens_per_page: int = 16
    axis: str = "per_token"
    keep_raw: bool = True  # else what cannot be coded is an error
    protected: Protected = field(default_factory=Protected)

    def pages(self, shape: TensorShape) -> int:
        return -(-shape.tokens // self.tokens_per_page)


def _block_id(shape: TensorShape, per_page: int) -> Column:
    start = F.col("page_id") * per_page
    length = F.least(F.lit(per_page), shape.tokens - start)
    place = (F.col("batch") * shape.layers + F.col("layer")) * shape.heads + F.col("head")
    return place * length + F.col("token") - start


def encode_tensor(rows: DataFrame, shape: TensorShape, profile: PageProfile, fib: wire.FibProfile) -> DataFrame:
    """(page_id, block_id, batch, layer, head, token, raw, reason, payload, digest): a row per block."""
    if profile.axis not in AXES:
        raise ValueError("unknown axis")
    per_page = profile.tokens_per_page
    outside = (F.col("batch") >= shape.batch) | (F.col("layer") >= shape.layers) | (F.col("head") >= shape.heads) | (F.col("token") >= shape.tokens)
    token = F.when(outside, F.raise_error(F.lit("a vector lies outside the shape"))).otherwise(F.col("token"))
    placed = rows.withColumn("token", token.cast("int")).withColumn("page_id", F.floor(F.col("token") / per_page).cast("int"))
    placed = placed.select(
        "page_id", _block_id(shape, per_page).cast("int").alias("block_id"), "batch", "layer", "head", "token",
        profile.protected.holds(shape, F.col("layer"), F.col("head"), F.col("token")).alias("protected"), "x",
    )
    names = ["page_id", "block_id", "batch", "layer", "head", "token"]

    def encode(batch):
        x = quantize.checked(batch.column("x").to_pylist(), shape.head_dim)
        protected = batch.column("protected").to_numpy(zero_copy_only=False)
        plain = np.full(len(x), profile.axis == "raw")
        unsupported = np.full(len(x), profile.axis in ("per_channel", "role_aware"))
        norm = np.sqrt((x * x).sum(1))
        with np.errstate(over="ignore"):
            narrow = norm.astype(wire.NORMS[fib.norm][1])
        unfit = ~(np.isfinite(narrow) & (narrow > 0))
        reason = np.select([protected, plain, unsupported, unfit], ["protected_region", "raw_axis_policy", "unsupported_axis_raw_fallback", "encode_fallback"], "fib_quant_per_token")
        if not profile.keep_raw and ((unsupported | unfit) & ~protected).any():
            raise ValueError("a vector cannot be coded and may not stay raw")
        raw = reason != "fib_quant_per_token"
        payload = [v.astype("<f4").tobytes() for v in x]
        coded = np.flatnonzero(~raw)
        if len(coded):
            norms, words = quantize.fib(fib).encode(x[coded])
            for i, n, w in zip(coded.tolist(), norms, words, strict=True):
                payload[i] = wire.fb1_encode(fib, n, w)
        return {c: batch.column(c) for c in names} | {"raw": raw, "reason": reason.tolist(), "payload": pa.array(payload, pa.binary())}

    blocks = arrow_map(placed, encode, ", ".join(f"{c} int" for c in names) + ", raw boolean, reason string, payload binary")
    return blocks.withColumn("digest", F.sha2("payload", 256))


def pages_of(blocks: DataFrame, profile: PageProfile) -> DataFrame:
    """(page_id, token_start, token_count, blocks, raw_blocks, bytes, page_digest): a page's blocks are bounded by its geometry."""
    ordered = F.array_sort(F.collect_list(F.struct("block_id", "digest")))
    pages = blocks.groupBy("page_id").agg(
        F.min("token").alias("token_start"), (F.max("token") - F.min("token") + 1).alias("token_count"), F.count("*").alias("blocks"),
        F.count_if("raw").alias("raw_blocks"), F.sum(F.octet_length("payload")).alias("bytes"), ordered.alias("d"),
    )
    body = F.concat_ws("|", F.col("page_id"), F.col("token_start"), F.col("token_count"), F.lit(profile.tokens_per_page), F.array_join("d.digest", ","))
    return pages.withColumn("page_digest", F.sha2(body, 256)).drop("d")


def page_violations(blocks: DataFrame, pages: DataFrame, shape: TensorShape, profile: PageProfile) -> DataFrame:
    """(page_id, violations) of the stored pages against their blocks; an empty array where all holds."""
    own = pages_of(blocks, profile)
    ids = blocks.groupBy("page_id").agg(
        F.min("block_id").alias("least_id"), F.max("block_id").alias("most_id"), F.count_distinct("block_id").alias("ids"),
        F.count_if(F.sha2("payload", 256) != F.col("digest")).alias("damaged"),
        F.count_if((F.col("raw") & (F.octet_length("payload") != 4 * shape.head_dim)) | (~F.col("raw") & (F.expr("substring(payload, 1, 3)") != F.lit(wire.FB1)))).alias("odd"),
    )
    kept = pages.select("page_id", *[F.col(c).alias(f"s_{c}") for c in ("token_start", "token_count", "raw_blocks", "page_digest")])
    met = kept.join(own, "page_id", "left").join(ids, "page_id", "left")
    c = F.col
    return met.select("page_id", violations(
        ("no_blocks", c("blocks").isNull()), ("span_empty", c("s_token_count") <= 0), ("span_outside", c("s_token_start") + c("s_token_count") > shape.tokens),
        ("page_too_long", c("s_token_count") > profile.tokens_per_page), ("raw_count", c("s_raw_blocks") != c("raw_blocks")),
        ("block_ids", (c("least_id") != 0) | (c("most_id") != c("ids") - 1) | (c("ids") != c("blocks"))),
        ("token_outside", (c("token_start") < c("s_token_start")) | (c("token_start") + c("token_count") > c("s_token_start") + c("s_token_count"))),
        ("block_form", c("odd") > 0), ("block_damaged", c("damaged") > 0), ("page_digest", c("s_page_digest") != c("page_digest")),
    ).alias("violations"))


def decode_tensor(blocks: DataFrame, shape: TensorShape, fib: wire.FibProfile) -> DataFrame:
    """(batch, layer, head, token, x) of blocks whose digests hold; others are an error."""
    names = ["batch", "layer", "head", "token"]
    right = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a block's digest does not hold")))

    def decode(batch):
        out = np.empty((batch.num_rows, shape.head_dim))
        for i, (raw, payload) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("payload").to_pylist(), strict=True)):
            if raw:
                out[i] = np.frombuffer(payload, "<f4")
            else:
                norm, words = wire.fb1_decode(fib, payload)
                out[i] = quantize.fib(fib).decode([norm], words[None])[0]
        return {c: batch.column(c) for c in names} | {"x": lists(out)}

    return arrow_map(blocks.select(*names, "raw", right.alias("payload")), decode, ", ".join(f"{c} int" for c in names) + ", x array<double>")


def compression_receipt(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: (encoded_pages, compressed_blocks, raw_blocks, fallback_reasons, bytes)."""
    b = blocks.agg(
        F.count_if(~F.col("raw")).alias("compressed_blocks"), F.count_if("raw").alias("raw_blocks"),
        F.array_sort(F.collect_set(F.when(F.col("raw"), F.col("reason")))).alias("fallback_reasons"), F.sum(F.octet_length("payload")).alias("bytes"),
    )
    return pages.agg(F.count("*").alias("encoded_pages")).crossJoin(b)  # a row each


def vector_offset(shape: TensorShape, batch: Column, layer: Column, head: Column, token: Column) -> Column:
    """Place of a vector's first number in the flat tensor; null outside the shape."""
    inside = batch.between(0, shape.batch - 1) & layer.between(0, shape.layers - 1) & head.between(0, shape.heads - 1) & token.between(0, shape.tokens - 1)
    at = ((batch.cast("bigint") * shape.layers + layer) * shape.heads + head) * shape.tokens + token
    return F.when(inside, at * shape.head_dim)


def vector_slice(values: Column, shape: TensorShape, batch: Column, layer: Column, head: Column, token: Column) -> Column:
    """One vector out of a flat array."""
    return F.slice(values, vector_offset(shape, batch, layer, head, token).cast("int") + 1, shape.head_dim)


def strides(shape: TensorShape) -> dict[str, int]:
    """Canonical strides of the flat tensor, in numbers."""
    out, size = {}, 1
    for name, n in (("dim", shape.head_dim), ("token", shape.tokens), ("head", shape.heads), ("layer", shape.layers), ("batch", shape.batch)):
        out[name], size = size, size * n
    return out


def tensor_digest(rows: DataFrame) -> DataFrame:
    """(layer, digest) of the values as 32-bit floats, in the order of batch, head and token; bounded by a page at a time.

    rows as (page_id, batch, layer, head, token, x): pages are digested first, then a layer's pages.
    """
    at = F.struct("batch", "head", "token", F.transform("x", lambda v: v.cast("float")).alias("x"))
    page = rows.groupBy("layer", "page_id").agg(F.array_sort(F.collect_list(at)).alias("v"))
    page = page.select("layer", "page_id", F.sha2(F.to_json(F.col("v.x")), 256).alias("d"))
    return page.groupBy("layer").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "d"))), lambda s: s["d"]), ","), 256).alias("digest"))
