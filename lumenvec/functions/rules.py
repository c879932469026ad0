"""Contracts as columns: each names the rules that a row breaks, in their fixed order.

A null makes a rule broken where the rule needs the value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
PAGE_MAGIC, PAGE_VERSION = "PKV1", 1
MAX_HEADER, MAX_PAYLOAD, MAX_KIND, MAX_PROFILE = 4096, 1 << 30, 64, 128
MANIFEST_SCHEMA = "hybrid_state_manifest_v1"
DTYPE_BYTES = {"float32": 4, "float16": 2, "bfloat16": 2, "int8": 1, "int4": 1}
EXACT_WIDTH = {"f32": 4, "f16": 2, "bf16": 2, "i8": 1, "u8": 1}
#: Caps on what a store may use, in the order in which they are checked.
LIMITS = {
    "manifest_bytes": 32 << 20, "page_count": 1024, "page_bytes_max": 64 << 20, "component_count": 2048, "layer_count": 256, "rank": 8192,
    "dimension": 8192, "total_state_bytes": 32 << 30, "branch_depth": 1024, "live_states_per_principal": 256, "concurrent_requests": 128, "decode_budget": 240,
}
SHARED_CODECS = ("fib_k4_n32", "fib_k4_n32_batched", "exact_f32_fallback")
SHELL_CODEC = r"turbo_8bit|exact_f32_fallback|turbo_([2-9]|1[0-6])bit_batched(_lossy)?"


def violations(*rules: tuple[str, Column]) -> Column:
    """array<string> of the rules whose condition holds or is null."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules]))


def first(found: Column) -> Column:
    """The rule reported: the first broken one, or null."""
    return F.get(found, F.lit(0))


def checked_product(dims: Column) -> Column:
    """Product of an array of numbers; null where it leaves 64 bits."""
    return F.aggregate(dims, F.lit(1).cast("bigint"), lambda a, x: F.try_multiply(a, x.cast("bigint")))


def checked_area(dims: Column, max_dimension: int = LIMITS["dimension"]) -> Column:
    """struct(area, error): error is overflow or dimension."""
    area = checked_product(dims)
    error = F.when(area.isNull(), "overflow").when(F.exists(dims, lambda d: d > max_dimension), "dimension")
    return F.struct(F.when(error.isNull(), area).alias("area"), error.alias("error"))


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def page_header() -> Column:
    """Violations of the columns of a page header."""
    c = F.col
    dims = c("dims")
    return violations(
        ("magic", c("magic") != PAGE_MAGIC), ("schema_version", c("schema_version") != PAGE_VERSION),
        ("component_kind", _empty(c("component_kind")) | (F.octet_length("component_kind") > MAX_KIND)), ("rank", c("rank") < 1),
        ("dims", F.size(dims) != c("rank")), ("dim_zero", F.exists(dims, lambda d: d <= 0)), ("dim_overflow", checked_product(dims).isNull()),
        ("dtype", _empty(c("dtype"))), ("endianness", ~c("endianness").isin("l", "b")), ("digests", _empty(c("model_digest")) | _empty(c("layout_digest"))),
        ("positions", c("position_start") >= c("position_end")), ("codec_profile", _empty(c("codec_profile")) | (F.octet_length("codec_profile") > MAX_PROFILE)),
        ("payload_len", c("payload_len") > MAX_PAYLOAD), ("payload_digest", F.length("payload_digest") != 64), ("header_digest", F.length("header_digest") != 64),
        ("header_len", c("header_len") > MAX_HEADER),
    )


def bytes_per_element(dtype: Column) -> Column:
    """Null for an unknown type."""
    return reduce(lambda a, kv: a.when(dtype == kv[0], kv[1]), list(DTYPE_BYTES.items())[1:], F.when(dtype == "float32", DTYPE_BYTES["float32"]))


def exact_width(dtype: Column) -> Column:
    """Bytes of a number; null for packed bits."""
    return reduce(lambda a, kv: a.when(dtype == kv[0], kv[1]), list(EXACT_WIDTH.items())[1:], F.when(dtype == "f32", EXACT_WIDTH["f32"]))


def payload_size_holds() -> Column:
    return F.coalesce(F.col("payload_len") == checked_product(F.col("dims")) * bytes_per_element(F.col("dtype")), F.lit(False))


def resource_usage(limits: dict[str, int | None] | None = None) -> Column:
    """Violations of usage columns named as the limits; a limit of None caps nothing."""
    caps = LIMITS if limits is None else limits
    return violations(*[(name, F.col(name) > cap) for name, cap in caps.items() if cap is not None])


def principal(id_: Column, namespace: Column) -> Column:
    plain = lambda c: c.rlike("^[\\x00-\\x7F]*$")
    control = lambda c: c.rlike("[\\x00-\\x1F\\x7F]")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return violations(
        ("id_empty", blank(id_)), ("id_control", control(id_)), ("namespace_empty", blank(namespace)), ("namespace_control", control(namespace)),
        ("id_long", F.octet_length(id_) > 128), ("namespace_long", F.octet_length(namespace) > 256), ("ascii", ~plain(id_) | ~plain(namespace)),
    )


def execution_scope(run_id: Column, node_id: Column) -> Column:
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    control = lambda c: c.rlike("[\\x00-\\x1F\\x7F]")
    return violations(("run_empty", blank(run_id)), ("run_control", control(run_id)), ("node_empty", blank(node_id)), ("node_control", control(node_id)))


def model_shape(kind: Column) -> Column:
    """Columns num_layers, num_heads, num_kv_heads, head_dim, hidden_size; kind mha, mqa or gqa."""
    c = F.col
    zero = [(f"{n}_zero", c(n) <= 0) for n in ("num_layers", "num_heads", "num_kv_heads", "head_dim", "hidden_size")]
    return violations(
        *zero, ("mha", (kind == "mha") & (c("num_kv_heads") != c("num_heads"))), ("mqa", (kind == "mqa") & (c("num_kv_heads") != 1)),
        ("gqa", (kind == "gqa") & (c("num_kv_heads") >= c("num_heads"))), ("kind", ~kind.isin("mha", "mqa", "gqa")),
        ("hidden_size", F.coalesce(F.try_mod(c("hidden_size"), c("num_heads")) != 0, F.lit(False))),
    )


def cache_shape(kind: Column) -> Column:
    """The strict contract: columns batch, layers, q_heads, kv_heads, seq_len, head_dim."""
    c = F.col
    q, kv = c("q_heads"), c("kv_heads")
    zero = [(f"{n}_zero", c(n) <= 0) for n in ("batch", "layers", "q_heads", "kv_heads", "seq_len", "head_dim")]
    return violations(
        *zero, ("mha", (kind == "mha") & (q != kv)), ("mqa", (kind == "mqa") & ((kv != 1) | (q <= 1))), ("gqa", (kind == "gqa") & ((q <= kv) | (kv <= 1))),
        ("gqa_groups", (kind == "gqa") & F.coalesce(F.try_mod(q, kv) != 0, F.lit(False))), ("kind", ~kind.isin("mha", "mqa", "gqa")),
    )


def tensor_shape(kind: Column, role: Column, rope: Column) -> Column:
    """The tensor contract: columns batch, layers, kv_heads, q_heads, tokens, head_dim."""
    c = F.col
    q, kv = c("q_heads"), c("kv_heads")
    zero = [(f"{n}_zero", c(n) <= 0) for n in ("batch", "layers", "kv_heads", "q_heads", "tokens", "head_dim")]
    size = F.array(*[c(n).cast("bigint") for n in ("batch", "layers", "kv_heads", "tokens", "head_dim")])
    return violations(
        *zero, ("mha", (kind == "mha") & (q != kv)), ("mqa", (kind == "mqa") & (kv != 1)),
        ("groups", kind.isin("mqa", "gqa") & F.coalesce(F.try_mod(q, kv) != 0, F.lit(False))),
        ("key_rope", (role == "key") & (rope == "none")), ("value_rope", (role == "value") & (rope != "none")), ("overflow", checked_product(size).isNull()),
    )


def slice_request() -> Column:
    """Columns layer, start, end, head, role against layers, key_heads, value_heads, seq_len; null head means all."""
    c = F.col
    heads = heads_for(c("role"))
    return violations(
        ("layer", c("layer") >= c("layers")), ("span_empty", c("start") >= c("end")), ("span_outside", c("end") > c("seq_len")),
        ("head", c("head").isNotNull() & F.coalesce(c("head") >= heads, F.lit(False))),
    )


def heads_for(role: Column) -> Column:
    return F.when(role == "key", F.col("key_heads")).when(role == "value", F.col("value_heads"))


def compression_policy(shared: Column, shell: Column, k: Column, n: Column, bits: Column, projections: Column) -> Column:
    return violations(
        ("shared_codec", ~shared.isin(*SHARED_CODECS)), ("shell_codec", ~shell.rlike(f"^({SHELL_CODEC})$")), ("fib_k", (k < 1) | (k > 256)),
        ("fib_n", (n < 2) | (n > 1 << 20)), ("turbo_bits", (bits < 2) | (bits > 16)), ("turbo_projections", projections < 1),
    )


def fib_profile() -> Column:
    """Columns dim, block, words, index_bits, norm, restarts, iterations, samples."""
    c = F.col
    return violations(
        ("dim", c("dim") < 1), ("block", (c("block") < 1) | (c("block") >= c("dim"))), ("divisible", F.coalesce(F.try_mod(c("dim"), c("block")) != 0, F.lit(False))),
        ("words", c("words") < 2), ("index_bits", c("index_bits") != F.length(F.bin((c("words") - 1).cast("bigint")))), ("norm", c("norm") != "f16"),
        ("restarts", (c("restarts") < 1) | (c("restarts") > 64)), ("iterations", (c("iterations") < 1) | (c("iterations") > 1000)), ("samples", c("samples") < c("words")),
    )


def manifest() -> Column:
    """Columns schema_version, model_id, tokenizer_id, policy_digest, version_digest, components, page_refs (arrays of structs)."""
    c = F.col
    hole = lambda s, names: reduce(lambda a, n: a | _empty(s[n]), names, F.lit(False))
    return violations(
        ("schema", c("schema_version") != MANIFEST_SCHEMA), ("ids", _empty(c("model_id")) | _empty(c("tokenizer_id"))),
        ("digests", _empty(c("policy_digest")) | _empty(c("version_digest"))),
        ("components", F.exists("components", lambda s: hole(s, ("name", "version", "digest")))), ("page_refs", F.exists("page_refs", lambda s: hole(s, ("page_id", "digest")))),
    )


def polar_code(dim: int, bits: int) -> Column:
    """Columns radii, angles."""
    r, k = F.col("radii"), F.col("angles")
    return violations(
        ("pairs", (F.size(r) != dim // 2) | (F.size(k) != dim // 2)), ("radius", ~F.forall(r, lambda x: (x >= 0) & ~F.isnan(x) & (x < float("inf")))),
        ("angle", ~F.forall(k, lambda x: (x >= 0) & (x < 1 << bits))),
    )


def sign_sketch(projections: int) -> Column:
    s = F.col("signs")
    return violations(("signs", F.size(s) != projections), ("sign", ~F.forall(s, lambda x: x.isin(-1, 1))))


def turbo_code(dim: int, bits: int, projections: int) -> Column:
    return F.concat(polar_code(dim, bits - bool(projections)), sign_sketch(projections))
