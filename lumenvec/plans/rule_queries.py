"""Contracts, policies and identities: which rules rows break, and digests over canonical forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry, rules
from ..operators import kvpages
from ..sources import pages
from ..sources.tables import table
from .common import Plans
from .vector_queries import r6

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles
T = table
C = F.col


def joined(found):
    return F.array_join(found, ",").alias("broken")


def broken_sql(*rules_: tuple[str, str]) -> str:
    """The names of the conditions that hold, joined."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules_) + "], lambda r: r IS NOT NULL), ',') AS broken"


# ---------------------------------------------------------------- page headers

_HEAD = "h AS (SELECT p_partkey AS id, p_size AS s, CASE WHEN p_size % 13 = 0 THEN 'XXXX' ELSE 'PKV1' END AS magic, 1 + p_size // 47 AS version, CASE WHEN p_size % 11 = 0 THEN '' ELSE p_name END AS kind, p_size % 4 AS rank, p_size AS d1, p_size % 5 AS d2, CASE WHEN p_size % 2 = 0 THEN 'l' ELSE CASE WHEN p_size % 3 = 0 THEN 'x' ELSE 'b' END END AS endian, CASE WHEN p_size % 7 = 0 THEN 'float16' WHEN p_size % 7 = 1 THEN 'int4' WHEN p_size % 7 = 2 THEN 'odd' ELSE 'float32' END AS dtype, p_size * (p_size % 5) * 4 AS len FROM part)"


def header_rows(spark, sf_dir):
    s = C("p_size")
    dims = F.array(s.cast("bigint"), (s % 5).cast("bigint"))
    return T(spark, sf_dir, "part").select(
        C("p_partkey").alias("id"), F.when(s % 13 == 0, "XXXX").otherwise("PKV1").alias("magic"), (1 + F.floor(s / 47)).cast("int").alias("schema_version"),
        F.when(s % 11 == 0, "").otherwise(C("p_name")).alias("component_kind"), (s % 4).alias("rank"), dims.alias("dims"),
        F.when(s % 7 == 0, "float16").when(s % 7 == 1, "int4").when(s % 7 == 2, "odd").otherwise("float32").alias("dtype"),
        F.when(s % 2 == 0, "l").otherwise(F.when(s % 3 == 0, "x").otherwise("b")).alias("endianness"), F.lit("m").alias("model_digest"), F.when(s % 17 == 0, "").otherwise("l").alias("layout_digest"),
        s.alias("position_start"), (s + s % 3).alias("position_end"), F.lit("raw").alias("codec_profile"), (s * (s % 5) * 4).cast("bigint").alias("payload_len"),
        F.sha2(C("p_name"), 256).alias("payload_digest"), F.when(s % 19 == 0, "short").otherwise(F.sha2(C("p_brand"), 256)).alias("header_digest"), (s * 100).alias("header_len"),
    )


@plans.add(f"WITH {_HEAD} SELECT id, " + broken_sql(("magic", "magic <> 'PKV1'"), ("schema_version", "version <> 1"), ("component_kind", "kind = '' OR strlen(kind) > 64"), ("rank", "rank < 1"), ("dims", "rank <> 2"), ("dim_zero", "d1 = 0 OR d2 = 0"), ("endianness", "endian NOT IN ('l', 'b')"), ("digests", "s % 17 = 0"), ("positions", "s % 3 = 0"), ("header_digest", "s % 19 = 0"), ("header_len", "s * 100 > 4096")) + " FROM h")
def header_rules(spark, sf_dir):
    return header_rows(spark, sf_dir).select("id", joined(rules.page_header()))


@plans.add(f"WITH {_HEAD} SELECT id, CAST(d1 * d2 AS BIGINT) AS elements, CASE dtype WHEN 'float32' THEN 4 WHEN 'float16' THEN 2 WHEN 'int4' THEN 1 END AS width, coalesce(len = d1 * d2 * CASE dtype WHEN 'float32' THEN 4 WHEN 'float16' THEN 2 WHEN 'int4' THEN 1 END, false) AS size_holds FROM h")
def header_sizes(spark, sf_dir):
    return header_rows(spark, sf_dir).select("id", rules.checked_product(C("dims")).alias("elements"), rules.bytes_per_element(C("dtype")).alias("width"), rules.payload_size_holds().alias("size_holds"))


_HJ = "to_json({{magic: 'PKV1', schema_version: 1, component_kind: 'page', header_len: {0}, rank: 1, dims: [strlen(html)], dtype: 'int8', endianness: 'l', model_digest: 'm', layout_digest: 'l', position_start: page_id, position_end: page_id + 1, codec_profile: 'raw', payload_len: strlen(html), payload_digest: repeat('0', 64), header_digest: repeat('0', 64)}})"
_HL = "strlen(" + _HJ.format("0") + ")"


def html_pages(spark, sf_dir):
    p = T(spark, sf_dir, "pages").where("html is not null")
    return p.select(
        "page_id", F.lit("page").alias("component_kind"), F.array(F.octet_length("html").cast("bigint")).alias("dims"), F.lit("int8").alias("dtype"), F.lit("l").alias("endianness"), F.lit("m").alias("model_digest"),
        F.lit("l").alias("layout_digest"), C("page_id").alias("position_start"), (C("page_id") + 1).alias("position_end"), F.lit("raw").alias("codec_profile"), F.encode("html", "UTF-8").alias("payload"),
    )


@plans.add(f"SELECT page_id, {_HL} AS header_len, sha256({_HJ.format(_HL)}) AS header_digest, sha256(html) AS payload_digest, '' AS broken FROM pages WHERE html IS NOT NULL")
def page_headers(spark, sf_dir):
    """Headers with their own length and digest, over canonical JSON."""
    h = pages.with_headers(html_pages(spark, sf_dir)).select("page_id", C("header.*"))
    return h.select("page_id", C("header_len").cast("bigint").alias("header_len"), "header_digest", "payload_digest", joined(rules.page_header()))


@plans.add("SELECT page_id, strlen(html) AS payload, CASE page_id % 5 WHEN 1 THEN 'payload_digest' WHEN 2 THEN 'payload_len' WHEN 3 THEN 'no_header' WHEN 4 THEN 'header_digest' END AS error FROM pages WHERE html IS NOT NULL AND html <> ''")
def page_parse(spark, sf_dir):
    """Page files read back; four of five are damaged in four ways, and each is found."""
    made = pages.with_headers(html_pages(spark, sf_dir)).where("length(payload) > 0")
    kind, whole = C("page_id") % 5, pages.page_bytes()
    header = C("header").withField("model_digest", F.lit("other"))
    content = (
        F.when(kind == 1, F.expr("concat(substring(c, 1, length(c) - 1), X'00')")).when(kind == 2, F.expr("concat(c, X'00')"))
        .when(kind == 3, F.expr("substring(c, 3, length(c))")).otherwise(C("c"))
    )
    files = made.withColumn("header", F.when(kind == 4, header).otherwise(C("header"))).withColumn("c", whole).select("page_id", F.octet_length("payload").cast("bigint").alias("n"), content.alias("content"))
    return pages.parse_pages(files).select("page_id", C("n").alias("payload"), "error")


@plans.add("WITH s AS (SELECT DISTINCT sha256(html) AS digest FROM pages WHERE page_id % 2 = 0), g AS (SELECT DISTINCT sha256(html) AS digest FROM pages WHERE page_id % 3 = 0) SELECT g.digest, s.digest IS NOT NULL AS deleted, (SELECT count(*) FROM s WHERE digest NOT IN (SELECT digest FROM g)) AS stay FROM g LEFT JOIN s ON s.digest = g.digest")
def page_delete(spark, sf_dir):
    p = T(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    stay, gone = pages.without_pages(p.where("page_id % 2 = 0").select("digest").distinct(), p.where("page_id % 3 = 0"))
    return gone.crossJoin(stay.agg(F.count("*").alias("stay")))  # one row


@plans.add("WITH p AS (SELECT page_id, sha256(html) AS digest FROM pages WHERE html IS NOT NULL) SELECT page_id % 10 AS state_id, page_id AS position_start, min(digest) AS digest FROM p GROUP BY 1, 2")
def page_find(spark, sf_dir):
    """Pages by state, kind and position; only those that the state refers to."""
    h = pages.with_headers(html_pages(spark, sf_dir)).select(C("header.payload_digest").alias("digest"), "header", "page_id")
    states = h.select((C("page_id") % 10).alias("state_id"), "digest").distinct()
    wanted = h.select((C("page_id") % 10).alias("state_id"), F.lit("page").alias("component_kind"), C("page_id").alias("position_start"))
    wanted = wanted.unionByName(wanted.select("state_id", F.lit("other").alias("component_kind"), "position_start"))
    return pages.find_pages(h.select("digest", "header"), wanted, states).select("state_id", "position_start", "digest")


# ---------------------------------------------------------------- limits and identities

_CAPS = [(n, f"{n} > {c}") for n, c in rules.LIMITS.items()]


@plans.add(
    "WITH u AS (SELECT user_id, count(*) * 20 AS page_count, max(event_id) * 10 AS manifest_bytes, sum(value) * 100000 AS page_bytes_max, count(*) AS component_count, count(DISTINCT event_type) * 60 AS layer_count, user_id * 100 AS rank, user_id * 90 AS dimension, "
    f"sum(value) * 10000000 AS total_state_bytes, user_id * 8 AS branch_depth, user_id * 2 AS live_states_per_principal, user_id AS concurrent_requests, user_id * 2 AS decode_budget FROM events GROUP BY user_id), b AS (SELECT user_id, {broken_sql(*_CAPS)} FROM u) SELECT user_id, broken, nullif(split_part(broken, ',', 1), '') AS reported FROM b"
)
def usage_limits(spark, sf_dir):
    """Twelve caps in their order; the first broken one is what is reported."""
    u = C("user_id")
    e = T(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.sum("value").alias("v"), F.count_distinct("event_type").alias("types"))
    named = {"manifest_bytes": C("last") * 10, "page_count": C("n") * 20, "page_bytes_max": C("v") * 100_000, "component_count": C("n"), "layer_count": C("types") * 60, "rank": u * 100, "dimension": u * 90, "total_state_bytes": C("v") * 10_000_000, "branch_depth": u * 8, "live_states_per_principal": u * 2, "concurrent_requests": u, "decode_budget": u * 2}
    found = e.select("user_id", *[c.alias(n) for n, c in named.items()]).withColumn("v", rules.resource_usage())
    return found.select("user_id", F.array_join("v", ",").alias("broken"), rules.first(C("v")).alias("reported"))


@plans.add("SELECT s_suppkey AS id, CASE WHEN s_nationkey % 4 = 0 THEN NULL WHEN greatest(s_nationkey * 500, 7) > 8192 THEN NULL ELSE CAST(s_nationkey * 500 AS BIGINT) * 7 END AS area, CASE WHEN s_nationkey % 4 = 0 AND s_nationkey > 0 THEN 'overflow' WHEN s_nationkey * 500 > 8192 THEN 'dimension' WHEN s_nationkey = 0 THEN 'dimension' END AS error FROM supplier")
def checked_areas(spark, sf_dir):
    """Products of dimensions that leave 64 bits, or of which one is too large."""
    n = C("s_nationkey").cast("bigint")
    dims = F.when(n % 4 == 0, F.array(n * 500, F.lit(1 << 40), F.lit(1 << 40))).otherwise(F.array(n * 500, F.lit(7).cast("bigint")))
    return T(spark, sf_dir, "supplier").select(C("s_suppkey").alias("id"), rules.checked_area(dims).alias("a")).select("id", "a.area", "a.error")


@plans.add("SELECT c_custkey AS id, " + broken_sql(("id_empty", "k % 7 = 0"), ("id_control", "k % 7 = 1"), ("namespace_empty", "k % 5 = 0"), ("id_long", "k % 7 = 2"), ("namespace_long", "k % 5 = 1"), ("ascii", "k % 7 = 3")) + ", CASE WHEN k % 3 = 0 THEN 'node_empty' ELSE '' END AS scope FROM (SELECT c_custkey, c_custkey % 35 AS k FROM customer)")
def principals(spark, sf_dir):
    k = C("c_custkey") % 35
    name = F.when(k % 7 == 0, "  ").when(k % 7 == 1, F.concat("c_name", F.lit("\x07"))).when(k % 7 == 2, F.repeat("c_name", 8)).when(k % 7 == 3, F.concat("c_name", F.lit("é"))).otherwise(C("c_name"))
    space = F.when(k % 5 == 0, "").when(k % 5 == 1, F.repeat(F.lit("n"), 257)).otherwise(F.lit("space"))
    scope = F.array_join(rules.execution_scope(F.lit("run"), F.when(k % 3 == 0, "").otherwise("node")), ",")
    return T(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), joined(rules.principal(name, space)), scope.alias("scope"))


_SH = "s AS (SELECT p_partkey AS id, p_size % 6 AS layers, p_size % 9 AS q, p_size % 5 AS kv, p_size % 7 * 8 AS dim, p_size AS hid, p_size % 4 AS bt, CASE p_size % 4 WHEN 0 THEN 'mha' WHEN 1 THEN 'mqa' WHEN 2 THEN 'gqa' ELSE 'odd' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'key' ELSE 'value' END AS role, CASE p_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'pre' ELSE 'post' END AS rope FROM part)"


def shape_rows(spark, sf_dir):
    s, k = C("p_size"), C("p_partkey")
    kind = F.when(s % 4 == 0, "mha").when(s % 4 == 1, "mqa").when(s % 4 == 2, "gqa").otherwise("odd")
    return T(spark, sf_dir, "part").select(
        k.alias("id"), (s % 6).alias("num_layers"), (s % 9).alias("num_heads"), (s % 5).alias("num_kv_heads"), (s % 7 * 8).alias("head_dim"), s.alias("hidden_size"), (s % 4).alias("batch"),
        kind.alias("kind"), F.when(k % 2 == 0, "key").otherwise("value").alias("role"), F.when(k % 3 == 0, "none").when(k % 3 == 1, "pre").otherwise("post").alias("rope"),
        (s % 6).alias("layers"), (s % 9).alias("q_heads"), (s % 5).alias("kv_heads"), s.alias("seq_len"), s.alias("tokens"),
    )


@plans.add(f"WITH {_SH} SELECT id, " + broken_sql(("num_layers_zero", "layers = 0"), ("num_heads_zero", "q = 0"), ("num_kv_heads_zero", "kv = 0"), ("head_dim_zero", "dim = 0"), ("mha", "kind = 'mha' AND kv <> q"), ("mqa", "kind = 'mqa' AND kv <> 1"), ("gqa", "kind = 'gqa' AND kv >= q"), ("kind", "kind = 'odd'"), ("hidden_size", "q > 0 AND hid % q <> 0")) + " FROM s")
def model_shapes(spark, sf_dir):
    return shape_rows(spark, sf_dir).select("id", joined(rules.model_shape(C("kind"))))


@plans.add(f"WITH {_SH} SELECT id, " + broken_sql(("batch_zero", "bt = 0"), ("layers_zero", "layers = 0"), ("q_heads_zero", "q = 0"), ("kv_heads_zero", "kv = 0"), ("head_dim_zero", "dim = 0"), ("mha", "kind = 'mha' AND kv <> q"), ("mqa", "kind = 'mqa' AND (kv <> 1 OR q <= 1)"), ("gqa", "kind = 'gqa' AND (q <= kv OR kv <= 1)"), ("gqa_groups", "kind = 'gqa' AND kv > 0 AND q % kv <> 0"), ("kind", "kind = 'odd'")) + " FROM s")
def cache_shapes(spark, sf_dir):
    """The strict contract of grouped heads."""
    return shape_rows(spark, sf_dir).select("id", joined(rules.cache_shape(C("kind"))))


@plans.add(f"WITH {_SH} SELECT id, " + broken_sql(("batch_zero", "bt = 0"), ("layers_zero", "layers = 0"), ("kv_heads_zero", "kv = 0"), ("q_heads_zero", "q = 0"), ("head_dim_zero", "dim = 0"), ("mha", "kind = 'mha' AND kv <> q"), ("mqa", "kind = 'mqa' AND kv <> 1"), ("groups", "kind IN ('mqa', 'gqa') AND kv > 0 AND q % kv <> 0"), ("key_rope", "role = 'key' AND rope = 'none'"), ("value_rope", "role = 'value' AND rope <> 'none'")) + " FROM s")
def tensor_shapes(spark, sf_dir):
    return shape_rows(spark, sf_dir).select("id", joined(rules.tensor_shape(C("kind"), C("role"), C("rope"))))


@plans.add(f"WITH {_SH} SELECT id, CAST(kv * dim * 2 AS BIGINT) AS per_token_layer, CAST(kv * dim * 8 AS BIGINT) AS bytes_per_token_layer, CAST(layers * hid * kv * dim * 2 AS BIGINT) AS total, CAST(layers * hid * kv * dim * 8 AS BIGINT) AS total_bytes, CAST(bt * layers * kv * hid AS BIGINT) AS vectors, CAST(bt * layers * kv * hid * dim AS BIGINT) AS elements, CAST(CASE role WHEN 'key' THEN q ELSE kv END * hid * dim AS BIGINT) AS layer_elements, CASE rope WHEN 'none' THEN 4 WHEN 'pre' THEN 2 END AS width, CAST(ceil(hid / 16.0) AS BIGINT) AS pages FROM s")
def shape_products(spark, sf_dir):
    """Counts and bytes that follow from a shape."""
    s = shape_rows(spark, sf_dir)
    of = lambda *names: rules.checked_product(F.array(*[C(n).cast("bigint") if isinstance(n, str) else F.lit(n).cast("bigint") for n in names]))
    heads = s.withColumns({"key_heads": C("q_heads"), "value_heads": C("kv_heads")}).withColumn("own", rules.heads_for(C("role")))
    width = rules.exact_width(F.when(C("rope") == "none", "f32").when(C("rope") == "pre", "bf16").otherwise("packed_bits"))
    return heads.select(
        "id", of("kv_heads", "head_dim", 2).alias("per_token_layer"), of("kv_heads", "head_dim", 8).alias("bytes_per_token_layer"), of("layers", "tokens", "kv_heads", "head_dim", 2).alias("total"),
        of("layers", "tokens", "kv_heads", "head_dim", 8).alias("total_bytes"), of("batch", "layers", "kv_heads", "tokens").alias("vectors"), of("batch", "layers", "kv_heads", "tokens", "head_dim").alias("elements"),
        of("own", "tokens", "head_dim").alias("layer_elements"), width.alias("width"), F.ceil(C("tokens") / kvpages.PageProfile(16).tokens_per_page).alias("pages"),
    )


@plans.add(f"WITH {_SH} SELECT id, " + broken_sql(("layer", "hid % 5 >= layers"), ("span_empty", "hid % 10 >= hid % 8"), ("span_outside", "hid % 8 > hid"), ("head", "hid % 3 > 0 AND hid % 4 >= CASE role WHEN 'key' THEN q ELSE kv END")) + " FROM s")
def slice_requests(spark, sf_dir):
    s = C("hidden_size")
    asked = shape_rows(spark, sf_dir).withColumns({"layer": s % 5, "start": s % 10, "end": s % 8, "head": F.when(s % 3 > 0, s % 4), "key_heads": C("q_heads"), "value_heads": C("kv_heads")})
    return asked.select("id", joined(rules.slice_request()))


_PO = "p AS (SELECT p_partkey AS id, p_size AS s, CASE p_size % 4 WHEN 0 THEN 'fib_k4_n32' WHEN 1 THEN 'fib_k4_n32_batched' WHEN 2 THEN 'exact_f32_fallback' ELSE 'zip' END AS shared, 'turbo_' || (p_size % 20) || 'bit_batched' || CASE WHEN p_size % 2 = 0 THEN '_lossy' ELSE '' END AS shell FROM part)"


@plans.add(f"WITH {_PO} SELECT id, " + broken_sql(("shared_codec", "shared = 'zip'"), ("shell_codec", "s % 20 < 2 OR s % 20 > 16"), ("fib_k", "s % 6 = 0"), ("fib_n", "s % 9 < 2"), ("turbo_bits", "s % 20 < 2 OR s % 20 > 16"), ("turbo_projections", "s % 10 = 0")) + ", CASE WHEN s % 20 BETWEEN 2 AND 16 THEN shell END AS made FROM p")
def policy_rules(spark, sf_dir):
    """Two-tier policies; and the shell codec's id as it is made from bits and mode."""
    s = C("p_size")
    shared = F.when(s % 4 == 0, "fib_k4_n32").when(s % 4 == 1, "fib_k4_n32_batched").when(s % 4 == 2, "exact_f32_fallback").otherwise("zip")
    shell = F.concat(F.lit("turbo_"), (s % 20).cast("string"), F.lit("bit_batched"), F.when(s % 2 == 0, "_lossy").otherwise(""))
    found = rules.compression_policy(shared, shell, s % 6, s % 9, s % 20, s % 10)
    made = F.element_at(F.create_map(*[F.lit(x) for b in range(2, 17) for lossy in (False, True) for x in (f"{b}{lossy}", registry.turbo_codec_id(b, lossy))]), F.concat((s % 20).cast("string"), F.when(s % 2 == 0, "True").otherwise("False")))
    return T(spark, sf_dir, "part").select(C("p_partkey").alias("id"), joined(found), F.when((s % 20).between(2, 16), made).alias("made"))


# ---------------------------------------------------------------- manifests and layouts

_MAN = "to_json({schema_version: 'hybrid_state_manifest_v1', model_id: o_orderpriority, tokenizer_id: 't', page_refs: pg, parent_lineage: [CAST(o_orderkey // 4 AS VARCHAR)], policy_digest: 'p', version_digest: 'v'})"
_PG = "pg AS (SELECT l_orderkey, list({page_id: CAST(l_linenumber AS VARCHAR), digest: CAST(l_partkey AS VARCHAR)} ORDER BY l_linenumber, l_partkey) AS pg FROM lineitem GROUP BY 1), m AS (SELECT o_orderkey, o_orderpriority, pg FROM orders JOIN pg ON l_orderkey = o_orderkey)"


def manifests(spark, sf_dir):
    """(id, manifest): what identifies a state, in canonical order."""
    ref = F.struct(C("l_linenumber").cast("string").alias("page_id"), C("l_partkey").cast("string").alias("digest"))
    refs = T(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", ref.alias("r")))), lambda s: s["r"]).alias("page_refs"))
    m = T(spark, sf_dir, "orders").join(refs, "o_orderkey")
    fields = [
        F.lit(rules.MANIFEST_SCHEMA).alias("schema_version"), C("o_orderpriority").alias("model_id"), F.lit("t").alias("tokenizer_id"), "page_refs",
        F.array(F.floor(C("o_orderkey") / 4).cast("string")).alias("parent_lineage"), F.lit("p").alias("policy_digest"), F.lit("v").alias("version_digest"),
    ]
    return m.select(C("o_orderkey").alias("id"), F.struct(*fields).alias("manifest"))


def domain_digest(domain: str, body):
    """Digest of a domain, a zero byte and a body."""
    return F.sha2(F.concat(F.lit(domain), F.lit("\0"), body), 256)


def parts_digest(*parts):
    """Digest of parts, each after its length: no two lists of parts are alike."""
    return F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


@plans.add(f"WITH {_PG} SELECT o_orderkey AS id, 'hybrid-state-v1:' || sha256({_MAN}) AS state_id, sha256('manifest' || chr(0) || {_MAN}) AS domain_digest, true AS verified FROM m")
def manifest_ids(spark, sf_dir):
    """State ids by content: the digest of the manifest's canonical JSON, and that they verify."""
    m = manifests(spark, sf_dir)
    body = F.to_json("manifest")
    found = m.select("id", F.concat(F.lit("hybrid-state-v1:"), F.sha2(body, 256)).alias("state_id"), domain_digest("manifest", body).alias("domain_digest"), "manifest")
    return found.select("id", "state_id", "domain_digest", (C("state_id") == F.concat(F.lit("hybrid-state-v1:"), F.sha2(F.to_json("manifest"), 256))).alias("verified"))


@plans.add("SELECT o_orderkey AS id, " + broken_sql(("schema", "o_orderkey % 7 = 0"), ("ids", "o_orderkey % 5 = 0"), ("digests", "o_orderkey % 11 = 0"), ("components", "o_orderkey % 3 = 0"), ("page_refs", "o_orderkey % 13 = 0")) + " FROM orders")
def manifest_rules(spark, sf_dir):
    k = C("o_orderkey")
    hole = lambda n: F.when(k % n == 0, "").otherwise("x")
    rows = T(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 7 == 0, "old").otherwise(rules.MANIFEST_SCHEMA).alias("schema_version"), F.lit("m").alias("model_id"), hole(5).alias("tokenizer_id"), F.lit("p").alias("policy_digest"), hole(11).alias("version_digest"),
        F.array(F.struct(F.lit("c").alias("name"), hole(3).alias("version"), F.lit("d").alias("digest"))).alias("components"), F.array(F.struct(F.lit("p").alias("page_id"), hole(13).alias("digest"))).alias("page_refs"),
    )
    return rows.select("id", joined(rules.manifest()))


@plans.add("WITH c AS (SELECT s_nationkey AS layout, s_suppkey AS layer, CASE WHEN s_suppkey % 3 = 0 THEN 'recurrent' ELSE 'attention_kv' END AS kind, CASE WHEN s_suppkey % 11 = 0 THEN 5 ELSE s_suppkey END AS pos FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY layer) AS n, lag(pos) OVER (PARTITION BY layout ORDER BY layer) AS before FROM c), g AS (SELECT layout, coalesce(bool_or(before >= pos), false) AS unsorted, string_agg(strlen(kind) || ':' || kind || strlen(CAST(pos AS VARCHAR)) || ':' || pos, '' ORDER BY n) AS body FROM o GROUP BY layout) SELECT layout, unsorted, sha256(body) AS digest FROM g")
def layout_rules(spark, sf_dir):
    """Components of layouts: whether they are strictly sorted, and the digest of their length-prefixed bytes."""
    from pyspark.sql import Window

    k = C("s_suppkey")
    rows = T(spark, sf_dir, "supplier").select(C("s_nationkey").alias("layout"), k.alias("layer"), F.when(k % 3 == 0, "recurrent").otherwise("attention_kv").alias("kind"), F.when(k % 11 == 0, F.lit(5)).otherwise(k).cast("bigint").alias("pos"))
    w = Window.partitionBy("layout").orderBy("layer")  # a layout's components
    text = C("pos").cast("string")
    piece = F.concat(F.octet_length("kind").cast("string"), F.lit(":"), "kind", F.octet_length(text).cast("string"), F.lit(":"), text)
    o = rows.withColumns({"bad": F.lag("pos").over(w) >= C("pos"), "piece": piece})
    g = o.groupBy("layout").agg(F.coalesce(F.bool_or("bad"), F.lit(False)).alias("unsorted"), F.array_sort(F.collect_list(F.struct("layer", "piece"))).alias("p"))
    return g.select("layout", "unsorted", F.sha2(F.array_join("p.piece", ""), 256).alias("digest"))


@plans.add("SELECT p_partkey AS id, sha256(strlen(p_name) || ':' || p_name || strlen(p_brand) || ':' || p_brand) AS digest FROM part")
def parts_digests(spark, sf_dir):
    return T(spark, sf_dir, "part").select(C("p_partkey").alias("id"), parts_digest("p_name", "p_brand").alias("digest"))


# ---------------------------------------------------------------- protection and admission

_PR = "(t < 2 OR t + 1 >= 8 OR l = 3 OR h IN (1, 2))"


@plans.add(f"SELECT id, {_PR} AS protected, CASE WHEN {_PR} THEN 'raw:protected' WHEN NOT cal THEN 'raw:uncalibrated' WHEN is_key THEN 'per_channel' ELSE 'per_token' END AS decision FROM (SELECT p_partkey AS id, p_size % 8 AS t, p_size % 4 AS l, p_size % 5 AS h, p_size % 3 <> 0 AS cal, p_partkey % 2 = 0 AS is_key FROM part)")
def kv_decisions(spark, sf_dir):
    """What happens to a vector: protected, not calibrated, else by its role."""
    from ..operators import state

    s, shape = C("p_size"), kvpages.TensorShape(1, 4, 5, 8, 8)
    held = kvpages.Protected(2, 1, (3,), (1, 2)).holds(shape, s % 4, s % 5, s % 8)
    return T(spark, sf_dir, "part").select(C("p_partkey").alias("id"), held.alias("protected"), state.compression(held, s % 3 != 0, C("p_partkey") % 2 == 0).alias("decision"))


@plans.add("SELECT id, CASE WHEN kind IN ('full_attn_k', 'full_attn_v') AND asked IN ('raw_exact', CASE kind WHEN 'full_attn_k' THEN 'radii_preserved' ELSE 'radii_lossy' END) THEN asked ELSE 'raw_exact' END AS profile, CASE WHEN kind = 'odd' THEN 'unknown component kind: odd' WHEN asked IS NULL OR asked = 'raw_exact' THEN NULL WHEN kind = 'full_attn_k' AND asked = 'radii_preserved' THEN NULL WHEN kind = 'full_attn_v' AND asked = 'radii_lossy' THEN NULL ELSE asked || ' is not admitted for ' || kind END AS reason FROM (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'full_attn_k' WHEN 1 THEN 'full_attn_v' WHEN 2 THEN 'conv_state' ELSE 'odd' END AS kind, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'radii_preserved' WHEN 2 THEN 'radii_lossy' ELSE 'raw_exact' END AS asked FROM part)")
def profile_admission(spark, sf_dir):
    """Profiles asked for, by a table of those admitted; raw otherwise, with the reason."""
    from ..operators import policy

    s = C("p_size")
    kind = F.when(s % 4 == 0, "full_attn_k").when(s % 4 == 1, "full_attn_v").when(s % 4 == 2, "conv_state").otherwise("odd")
    asked = F.when(s % 5 == 0, F.lit(None).cast("string")).when(s % 5 == 1, "radii_preserved").when(s % 5 == 2, "radii_lossy").otherwise("raw_exact")
    admitted = policy.CONSERVATIVE | {"full_attn_k": ("raw_exact", "radii_preserved"), "full_attn_v": ("raw_exact", "radii_lossy")}
    found = policy.resolve(kind, asked, admitted, reject_unknown=True)
    return T(spark, sf_dir, "part").select(C("p_partkey").alias("id"), found.alias("f")).select("id", "f.profile", "f.reason")


@plans.add("SELECT c_custkey AS id, c_nationkey % 5 <> 0 AND c_custkey % 11 <> 0 AND 1000 < c_acctbal AND 12 <= c_nationkey AND c_custkey % 8 & 2 <> 0 AND c_acctbal - 1000 <= 5000 AS reusable FROM customer")
def reuse_decisions(spark, sf_dir):
    """A state is reused if its lease is active and it is young enough."""
    from ..operators import policy, state
    from .state_queries import leases

    status = state.lease_status(now=1000, epoch=12, right=2)
    return leases(spark, sf_dir).select("id", policy.reusable(status, F.col("expires") - 1000, 5000).alias("reusable"))


@plans.add("SELECT p_size AS size, round(p_size % 8 * 32 / ceil(log2(p_size + 1)), 6) AS ratio, count(*) AS n FROM part GROUP BY 1, 2")
def nominal_ratios(spark, sf_dir):
    from ..operators import policy

    s = C("p_size")
    return T(spark, sf_dir, "part").groupBy(s.alias("size"), r6(policy.nominal_ratio(s % 8, s + 1)).alias("ratio")).agg(F.count("*").alias("n"))
