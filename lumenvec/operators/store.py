"""The two-tier store: one pool of shared tokens, a shell of own tokens per agent.

A token is a flat vector over (layer, head, key or value, coordinate).  It is
un-nested to a row per vector; vectors of a (layer, role) are encoded together
in blobs of ``tokens_per_blob`` tokens, so a task holds one blob's rows however
long the corpus.  Order within a blob is token, then head.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import arrow_map, lists
from ..functions import registry

TOKENS_PER_BLOB = 1024
#: Digests folded into one at a time.
FAN = 1024
ROLES = ("key", "value")


@dataclass(frozen=True)
class Shape:
    """layers x kv_heads x head_dim, keys and values."""

    layers: int
    kv_heads: int
    head_dim: int

    @property
    def flat(self) -> int:
        return self.layers * self.kv_heads * self.head_dim * 2

    def raw_bytes(self, tokens: Column | int) -> Column:
        return F.lit(tokens) * self.flat * 4 if isinstance(tokens, int) else tokens * self.flat * 4


def unnest(tokens: DataFrame, shape: Shape) -> DataFrame:
    """(keys of the token, layer, head, role, x) of tokens with a flat ``vector``.

    A wrong length or a number that is not finite is an error.
    """
    v = F.col("vector")
    bad = (F.size(v) != shape.flat) | F.exists(v, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))
    safe = F.when(v.isNull() | bad, F.raise_error(F.lit(f"a token needs {shape.flat} finite numbers"))).otherwise(v)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(shape.flat // shape.head_dim - 1)), lambda i: F.slice(safe, i * shape.head_dim + 1, shape.head_dim))
    rest = [c for c in tokens.columns if c != "vector"]
    cut = tokens.select(*rest, F.posexplode(pieces).alias("at", "x"))
    at = F.col("at")
    return cut.select(
        *rest, F.floor(at / (2 * shape.kv_heads)).cast("int").alias("layer"), (F.floor(at / 2) % shape.kv_heads).cast("int").alias("head"),
        F.when(at % 2 == 0, "key").otherwise("value").alias("role"), "x",
    )


def nest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, layer, k, v): a layer's vectors back in token-major, head-minor order, a row per token and layer."""
    ordered = lambda role: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("head", "x")))), lambda s: s["x"]))
    return rows.groupBy(*keys, "layer").agg(ordered("key").alias("k"), ordered("value").alias("v"))


def encode_blobs(rows: DataFrame, keys: list[str], codec_id: str, head_dim: int, tokens_per_blob: int = TOKENS_PER_BLOB) -> DataFrame:
    """(keys, chunk, codec, n_vectors, first_pos, payload, payload_digest, bytes); rows as (keys, pos, head, x).

    pos counts tokens from 0 within each of the keys.
    """
    rows = rows.withColumn("chunk", F.floor(F.col("pos") / tokens_per_blob))
    group = [*keys, "chunk"]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pos", "ascending"), ("head", "ascending")])
        raw = registry.create(codec_id, head_dim).encode_batch(table.column("x").to_pylist())
        one = {c: table.column(c).slice(0, 1).combine_chunks() for c in group}
        first = table.column("pos").slice(0, 1).combine_chunks().cast(pa.int64())
        return pa.table(one | {"n_vectors": pa.array([table.num_rows], pa.int64()), "first_pos": first, "payload": pa.array([raw], pa.binary())})

    blobs = rows.select(*group, "pos", "head", "x").groupBy(*group).applyInArrow(encode, f"{fields}, n_vectors bigint, first_pos bigint, payload binary")
    return blobs.select(
        *group, F.lit(codec_id).alias("codec"), "n_vectors", "first_pos", "payload", F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("bigint").alias("bytes"),
    )


def decode_blobs(blobs: DataFrame, keys: list[str], shape: Shape) -> DataFrame:
    """(keys, pos, head, x) of blobs whose digests hold; others are an error."""
    right = F.when(F.sha2("payload", 256) == F.col("payload_digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a blob's digest does not hold")))
    source = blobs.select(*keys, "first_pos", "codec", right.alias("payload"))
    fields = "".join(f"{c} {source.schema[c].dataType.simpleString()}, " for c in keys)

    def rows(batch):
        decoded = [registry.create(c, shape.head_dim).decode_batch(p) for c, p in zip(batch.column("codec").to_pylist(), batch.column("payload").to_pylist(), strict=True)]
        count = np.array([len(d) for d in decoded])
        row = np.repeat(np.arange(len(decoded)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first = batch.column("first_pos").to_numpy()[row]
        return {c: batch.column(c).take(pa.array(row)) for c in keys} | {"pos": first + nth // shape.kv_heads, "head": nth % shape.kv_heads, "x": lists(np.concatenate(decoded))}

    return arrow_map(source, rows, f"{fields}pos bigint, head int, x array<double>")


def layer_digests(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, layer, layer_digest): keys' digests, then values', each in the order of chunks, folded FAN at a time."""
    at = [*keys, "layer", "role"]
    part = blobs.withColumn("part", F.floor(F.col("chunk") / FAN))
    folded = part.groupBy(*at, "part").agg(F.array_sort(F.collect_list(F.struct("chunk", "payload_digest"))).alias("d"))
    folded = folded.select(*at, "part", F.sha2(F.array_join("d.payload_digest", ","), 256).alias("digest"))
    side = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("part", "digest")))), lambda s: s["digest"])
    both = folded.groupBy(*keys, "layer").agg(side("key").alias("key_digests"), side("value").alias("value_digests"))
    whole = F.struct(F.col("layer").alias("layer_index"), "key_digests", "value_digests")
    return both.select(*keys, "layer", F.sha2(F.to_json(whole), 256).alias("layer_digest"))


def build_pool(tokens: DataFrame, shape: Shape, codec_id: str = "fib_k4_n32_batched", tokens_per_blob: int = TOKENS_PER_BLOB) -> DataFrame:
    """Blobs of the shared tier; tokens as (pos, vector).  Keys: layer, role."""
    return encode_blobs(unnest(tokens.select("pos", "vector"), shape), ["layer", "role"], codec_id, shape.head_dim, tokens_per_blob)


def materialize_shells(tokens: DataFrame, shape: Shape, codec_id: str = "turbo_4bit_batched", tokens_per_blob: int = TOKENS_PER_BLOB) -> DataFrame:
    """Blobs of the agents' own tokens; tokens as (agent_id, pos, vector).  An agent without tokens has no blobs."""
    return encode_blobs(unnest(tokens.select("agent_id", "pos", "vector"), shape), ["agent_id", "layer", "role"], codec_id, shape.head_dim, tokens_per_blob)


def pool_manifest(blobs: DataFrame, shape: Shape, seed: int = 42) -> DataFrame:
    """One row: (pool_id, layer_digests, num_layers, shared_tokens, pool_bytes, raw_bytes, ratio, codec, build_seed).

    pool_id binds the layers, the shape, the codec and the seed.
    """
    layers = layer_digests(blobs, []).agg(F.array_sort(F.collect_list(F.struct("layer", "layer_digest"))).alias("l"))
    sizes = blobs.agg(F.sum("bytes").alias("pool_bytes"), F.sum("n_vectors").alias("n"), F.min("codec").alias("codec"))
    both = layers.crossJoin(sizes)  # a row each
    tokens = (F.col("n") / (2 * shape.kv_heads * shape.layers)).cast("bigint")
    raw = shape.raw_bytes(F.col("shared_tokens"))
    material = F.struct(F.col("l.layer_digest").alias("layer_digests"), *[F.lit(getattr(shape, f)).alias(f) for f in ("layers", "kv_heads", "head_dim")], F.lit(seed).alias("seed"), "codec")
    return both.withColumn("shared_tokens", tokens).select(
        F.sha2(F.to_json(material), 256).alias("pool_id"), F.col("l.layer_digest").alias("layer_digests"), F.size("l").alias("num_layers"), "shared_tokens",
        "pool_bytes", raw.alias("raw_bytes"), F.coalesce(F.try_divide(raw, "pool_bytes"), F.lit(0.0)).alias("ratio"), "codec", F.lit(seed).alias("build_seed"),
    )


def shell_manifests(agents: DataFrame, blobs: DataFrame, pool_id: str, shape: Shape, seed: int = 42) -> DataFrame:
    """(agent_id, pool_digest, unique_tokens, unique_layers, shell_bytes, shell_digest, codec, seed); empty shells too.

    agents as (agent_id); an empty shell's digest binds the agent and the pool.
    """
    digests = layer_digests(blobs, ["agent_id"]).groupBy("agent_id").agg(F.array_sort(F.collect_list(F.struct("layer", "layer_digest"))).alias("l"))
    sizes = blobs.groupBy("agent_id").agg(F.sum("bytes").alias("shell_bytes"), F.sum("n_vectors").alias("n"), F.min("codec").alias("codec"))
    met = agents.select("agent_id").distinct().join(sizes, "agent_id", "left").join(digests, "agent_id", "left")
    empty = F.concat(F.lit("empty_shell:"), F.col("agent_id").cast("string"), F.lit(f":{pool_id}"))
    return met.select(
        "agent_id", F.lit(pool_id).alias("pool_digest"), F.coalesce((F.col("n") / (2 * shape.kv_heads * shape.layers)).cast("bigint"), F.lit(0)).alias("unique_tokens"),
        F.coalesce(F.size("l"), F.lit(0)).alias("unique_layers"), F.coalesce("shell_bytes", F.lit(0)).alias("shell_bytes"),
        F.sha2(F.coalesce(F.array_join("l.layer_digest", ","), empty), 256).alias("shell_digest"), "codec", F.lit(seed).alias("seed"),
    )


def injection_receipts(blobs: DataFrame) -> DataFrame:
    """(agent_id, blocks, layers, bytes, traces): what a shell would put in, a trace per layer and role."""
    traces = blobs.groupBy("agent_id", "layer", "role").agg(F.count("*").alias("blocks"), F.sum("n_vectors").alias("vectors"), F.sum("bytes").alias("bytes"))
    return traces.groupBy("agent_id").agg(
        F.sum("blocks").alias("blocks"), F.count_distinct("layer").alias("layers"), F.sum("bytes").alias("bytes"),
        F.array_sort(F.collect_list(F.struct("layer", "role", "blocks", "vectors"))).alias("traces"),
    )


def overlay(base: DataFrame, pool: DataFrame, shells: DataFrame) -> DataFrame:
    """(agent_id, pos, layer, head, role, x): shared positions from the pool, own ones from the shell, others as they were.

    base as (agent_id, pos, layer, head, role, x); pool without an agent.
    """
    at = ["pos", "layer", "head", "role"]
    met = base.join(pool.select(*at, F.col("x").alias("shared")), at, "left")
    met = met.join(shells.select("agent_id", *at, F.col("x").alias("own")), ["agent_id", *at], "left")
    return met.select("agent_id", *at, F.coalesce("own", "shared", "x").alias("x"))


def positions(tokens: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """tokens with ``pos``: 0, 1, ... within the keys.  Keys must bound their groups."""
    return tokens.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def calibrate_component(rows: DataFrame, component: str, profile: str, codec_id: str, shape: Shape, tokens_per_blob: int = TOKENS_PER_BLOB) -> DataFrame:
    """One row: (component, profile, status, raw_bytes, coded_bytes, ratio, layers, exact) of a component under a profile.

    rows as un-nested; convolution and recurrent state takes raw_exact only.
    """
    kinds = {"full_attn_k": "key", "full_attn_v": "value"}
    spark = rows.sparkSession
    named = (F.lit(component).alias("component"), F.lit(profile).alias("profile"))
    if component not in kinds:
        status = "evaluated" if profile == "raw_exact" else "rejected"
        return spark.range(1).select(*named, F.lit(status).alias("status"), *[F.lit(0).cast("bigint").alias(c) for c in ("raw_bytes", "coded_bytes")], F.lit(0.0).alias("ratio"), F.lit(0).cast("bigint").alias("layers"), F.lit(status == "evaluated").alias("exact"))
    own = rows.where(F.col("role") == kinds[component]).select("layer", "pos", "head", "x")
    blobs = encode_blobs(own, ["layer"], codec_id, shape.head_dim, tokens_per_blob)
    sizes = blobs.agg((F.sum("n_vectors") * 4 * shape.head_dim).alias("raw_bytes"), F.sum("bytes").alias("coded_bytes"), F.count_distinct("layer").alias("layers"))
    back = decode_blobs(blobs, ["layer"], shape).select("layer", "pos", "head", F.col("x").alias("y"))
    worst = own.join(back, ["layer", "pos", "head"], "left").agg(F.max(F.coalesce(F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a - b))), F.lit(1.0))).alias("worst"))
    both = sizes.crossJoin(worst)  # a row each
    return both.select(*named, F.lit("evaluated").alias("status"), "raw_bytes", "coded_bytes", (F.col("raw_bytes") / F.greatest("coded_bytes", F.lit(1))).alias("ratio"), "layers", (F.col("worst") == 0).alias("exact"))


def calibration(rows: DataFrame, threshold: float) -> DataFrame:
    """(role, vectors, mean_norm, max_norm, outliers, axis) of un-nested rows: keys call for channels, values for tokens."""
    from ..functions.vec import norm

    size = norm(F.col("x"))
    return rows.groupBy("role").agg(
        F.count("*").alias("vectors"), F.avg(size).alias("mean_norm"), F.max(size).alias("max_norm"), F.count_if(size > threshold).alias("outliers"),
    ).withColumn("axis", F.when(F.col("role") == "key", "per_channel").otherwise("per_token"))
