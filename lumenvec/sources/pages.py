"""Pages and tensors as bytes: a JSON header line before the payload, and layers of 32-bit floats.

The store is a Parquet table (digest, header, payload) in folders by the first
digits of the digest, so a lookup reads one folder's row groups.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map, lists
from ..functions import rules

HEADER = (
    "magic string, schema_version int, component_kind string, header_len int, rank int, dims array<bigint>, dtype string, endianness string, model_digest string, "
    "layout_digest string, position_start bigint, position_end bigint, codec_profile string, payload_len bigint, payload_digest string, header_digest string"
)
_FIELDS = [f.split()[0] for f in HEADER.split(", ")]
_ZEROS = "0" * 64


def _json(columns: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[columns[n].alias(n) for n in _FIELDS]))


def with_headers(pages: DataFrame) -> DataFrame:
    """pages with ``header``: a struct of all fields, digests and the header's own length included.

    pages as (component_kind, dims, dtype, endianness, model_digest, layout_digest,
    position_start, position_end, codec_profile, payload, ...).  The header's
    digest covers all fields with both digests as zeros; its length is that of
    the JSON before the length itself was known.
    """
    own = {n: F.col(n) for n in _FIELDS if n in pages.columns and n not in ("rank", "magic")}
    own |= {"magic": F.lit(rules.PAGE_MAGIC), "schema_version": F.lit(rules.PAGE_VERSION), "rank": F.size("dims"), "payload_len": F.octet_length("payload").cast("bigint")}
    own["dims"] = F.col("dims").cast("array<bigint>")
    zeros = {"payload_digest": F.lit(_ZEROS), "header_digest": F.lit(_ZEROS)}
    length = F.octet_length(_json(own | zeros | {"header_len": F.lit(0)}))
    sized = pages.withColumn("header_len", length)
    own["header_len"] = F.col("header_len")
    sized = sized.withColumn("header_digest", F.sha2(_json(own | zeros), 256)).withColumn("payload_digest", F.sha2("payload", 256))
    whole = own | {"payload_digest": F.col("payload_digest"), "header_digest": F.col("header_digest")}
    header = F.struct(*[whole[n].alias(n) for n in _FIELDS])
    return sized.withColumn("header", header).select(*pages.columns, "header")


def page_bytes() -> Column:
    """A page's file: the header as a JSON line, then the payload."""
    return F.concat(F.encode(F.concat(F.to_json("header"), F.lit("\n")), "UTF-8"), F.col("payload"))


def parse_pages(files: DataFrame) -> DataFrame:
    """(the columns but content, header, payload, error) of (content): what page_bytes made, checked.

    error names the first broken rule: no_header, header_len, the header's
    contract, payload_len, payload_digest, header_digest; null where all holds.
    """
    rest = [c for c in files.columns if c != "content"]
    head = F.decode(F.expr(f"substring(content, 1, {rules.MAX_HEADER + 1})"), "ISO-8859-1")  # one character a byte
    at = F.locate("\n", head)
    cut = files.withColumn("__at", at).withColumn("__line", F.decode(F.expr("substring(content, 1, greatest(__at - 1, 0))"), "UTF-8"))
    cut = cut.withColumn("header", F.from_json("__line", HEADER)).withColumn("payload", F.expr("substring(content, __at + 1, length(content))"))
    h = cut.select(*rest, "header", "payload", "__at", F.col("header.*"))
    zeroed = {n: F.col(n) for n in _FIELDS} | {"payload_digest": F.lit(_ZEROS), "header_digest": F.lit(_ZEROS)}
    error = (
        F.when((F.col("__at") == 0) | F.col("magic").isNull(), "no_header").when(F.size(rules.page_header()) > 0, rules.first(rules.page_header()))
        .when(F.col("payload_len") != F.octet_length("payload"), "payload_len").when(F.sha2("payload", 256) != F.col("payload_digest"), "payload_digest")
        .when(F.sha2(_json(zeroed), 256) != F.col("header_digest"), "header_digest")
    )
    return h.withColumn("error", error).select(*rest, "header", "payload", "error")


def without_pages(store: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store without the pages of (digest), and (digest, deleted): whether each was there."""
    gone = digests.select("digest").distinct()
    there = gone.join(store.select("digest").distinct().withColumn("there", F.lit(True)), "digest", "left")
    return store.join(gone, "digest", "left_anti"), there.select("digest", F.coalesce("there", F.lit(False)).alias("deleted"))


def find_pages(pages: DataFrame, wanted: DataFrame, states: DataFrame) -> DataFrame:
    """Pages of (state_id, component_kind, position_start): by their place, among those that the state refers to.

    states as (state_id, digest); of several the least digest.  Each page goes to
    the fewer of those that ask for its place and those that refer to it, and the
    other side confirms: a state of many pages, a place that all ask for or a
    page that all hold makes no pairs.
    """
    place = ["component_kind", "position_start"]
    own = pages.select("digest", *[F.col(f"header.{c}").alias(c) for c in place]).distinct()
    wanted, states = wanted.select("state_id", *place).distinct(), states.select("state_id", "digest").distinct()
    met = own.join(wanted.groupBy(*place).agg(F.count("*").alias("asked")), place).join(states.groupBy("digest").agg(F.count("*").alias("held")), "digest")
    by_place = met.where("asked <= held").select(*own.columns).join(wanted, place).join(states, ["state_id", "digest"], "left_semi")
    by_page = met.where("asked > held").select(*own.columns).join(states, "digest").join(wanted, ["state_id", *place], "left_semi")
    return by_place.unionByName(by_page).groupBy("state_id", *place).agg(F.min("digest").alias("digest"))


def recover(spark: SparkSession, path: str) -> DataFrame:
    """(name, status) of a folder of page files: temporary, valid or the broken rule."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.page").load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.page$", 1).alias("name"), "content")
    parsed = parse_pages(named)
    digest = F.when(F.col("header.payload_digest") != F.col("name"), "name")
    return parsed.select("name", F.when(F.col("name").startswith(".tmp."), "temporary").otherwise(F.coalesce("error", digest, F.lit("valid"))).alias("status"))


# ---------------------------------------------------------------- layers of keys and values


def kv_bytes(manifest: dict, layers: list[tuple]) -> bytes:
    """Length and JSON of the manifest, then per layer the count and the 32-bit floats of keys, and of values."""
    head = json.dumps(manifest, separators=(",", ":")).encode()
    parts = [len(head).to_bytes(8, "little"), head]
    for side in (s for layer in layers for s in layer):
        values = np.asarray(side, "<f4")
        parts += [len(values).to_bytes(4, "little"), values.tobytes()]
    return b"".join(parts)


def kv_layers(raw: bytes) -> tuple[dict, list[tuple[np.ndarray, np.ndarray]]]:
    """The inverse; a file that ends early or late is an error."""
    if len(raw) < 8 or (at := 8 + int.from_bytes(raw[:8], "little")) > len(raw):
        raise ValueError("short manifest")
    sides = []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        if at + 4 + 4 * n > len(raw):
            raise ValueError("short layer")
        sides.append(np.frombuffer(raw, "<f4", n, at + 4))
        at += 4 + 4 * n
    if len(sides) % 2:
        raise ValueError("a layer without values")
    return json.loads(raw[8 : 8 + int.from_bytes(raw[:8], "little")]), list(zip(sides[::2], sides[1::2], strict=True))


def write_kv(nested: DataFrame, key: str) -> DataFrame:
    """(key, content) of (key, layer, k, v): a file's bytes per key; its layers are bounded by the model."""
    whole = nested.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", "k", "v"))).alias("layers"))

    def rows(batch):
        blobs = [kv_bytes({"layers": len(x), "key": str(n)}, [(r["k"], r["v"]) for r in x]) for n, x in zip(batch.column(key).to_pylist(), batch.column("layers").to_pylist(), strict=True)]
        return {key: batch.column(key), "content": pa.array(blobs, pa.binary())}

    return arrow_map(whole, rows, f"{key} {nested.schema[key].dataType.simpleString()}, content binary")


def read_kv(files: DataFrame, key: str) -> DataFrame:
    """(key, layer, role, values) of (key, content)."""

    def rows(batch):
        names, layers, roles, found = [], [], [], []
        for i, raw in enumerate(batch.column("content").to_pylist()):
            for n, pair in enumerate(kv_layers(raw)[1]):
                for role, values in zip(("key", "value"), pair, strict=True):
                    names.append(i)
                    layers.append(n)
                    roles.append(role)
                    found.append(values)
        sizes = np.concatenate([[0], np.cumsum([len(v) for v in found])]).astype(np.int32)
        flat = np.concatenate(found).astype(np.float64) if found else np.empty(0)
        return {key: batch.column(key).take(pa.array(names, pa.int64())), "layer": pa.array(layers, pa.int32()), "role": pa.array(roles, pa.string()), "values": pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))}

    return arrow_map(files.select(key, "content"), rows, f"{key} {files.schema[key].dataType.simpleString()}, layer int, role string, values array<double>")


# ---------------------------------------------------------------- corpora


def corpus_of(tokens: DataFrame, shape: dict, seed: int = 42) -> DataFrame:
    """(json): tokens (pos, id, vector) as lines of a corpus, a line per token, each with the shape and the seed.

    Lines, not one document: no task and no driver holds the corpus.
    """
    fixed = F.struct(*[F.lit(v).alias(k) for k, v in shape.items()])
    return tokens.select(F.to_json(F.struct(fixed.alias("shape"), "pos", F.struct("id", "vector").alias("token"), F.lit(seed).alias("seed"))).alias("value"))


def synthetic_tokens(spark: SparkSession, agents: int, shared: int, unique: int, flat: int, seed: int = 42) -> DataFrame:
    """(agent_id, pos, id, vector): normal numbers, the shared tier without an agent; each row is drawn from its own seed."""
    tier = spark.range(0, shared).selectExpr("cast(null as bigint) as agent_id", "id as pos")
    own = spark.range(0, agents * unique).selectExpr(f"id div {unique} as agent_id", f"id % {unique} as pos")

    def draw(batch):
        agent, pos = batch.column("agent_id").to_pylist(), batch.column("pos").to_pylist()
        x = np.stack([np.random.default_rng([seed, 0 if a is None else a + 1, p]).standard_normal(flat) for a, p in zip(agent, pos, strict=True)])
        names = [f"shared_{p}" if a is None else f"agent_{a}_{p}" for a, p in zip(agent, pos, strict=True)]
        return {"agent_id": batch.column("agent_id"), "pos": batch.column("pos"), "id": names, "vector": lists(x)}

    return arrow_map(tier.unionByName(own), draw, "agent_id bigint, pos bigint, id string, vector array<float>")
