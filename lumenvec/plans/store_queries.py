"""Pool, shells, paged tensors and coded caches; embeddings stand in for tokens of 2 layers, 2 heads and 8 numbers."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import vec
from ..functions.wire import FibProfile, TurboProfile
from ..operators import kvcache, kvpages, store
from ..sources import pages
from ..sources.tables import table, vectors
from .codec_queries import _EST, _TB4, back_sql, rotated_sql, turbo_sql
from .common import Plans
from .vector_queries import _V, D, r6

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles
SHAPE = store.Shape(2, 2, 8)
BOOK = C.initial_codebook(8, 4, 32)
N = 1024  # tokens of a blob
_KV = "kv AS (SELECT id AS pos, ix // 4 AS layer, ix // 2 % 2 AS head, CASE WHEN ix % 2 = 0 THEN 'key' ELSE 'value' END AS role, list_transform(range(1, 9), lambda j: x[ix*8+j]) AS x FROM (SELECT id, x, unnest(range(0, 8)) AS ix FROM v))"
_CHUNKS = "c AS (SELECT id // 1024 AS chunk, count(*) AS tokens FROM v GROUP BY 1)"


def tokens(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("id").alias("pos"), F.col("x").alias("vector"))


def kv_rows(spark, sf_dir):
    return store.unnest(tokens(spark, sf_dir), SHAPE)


@plans.add(f"WITH {_V}, {_KV} SELECT pos, CAST(layer AS INTEGER) AS layer, CAST(head AS INTEGER) AS head, role, round(x[1], 6) AS first, round(list_sum(x), 6) AS total FROM kv")
def unnest_tokens(spark, sf_dir):
    return kv_rows(spark, sf_dir).select("pos", "layer", "head", "role", r6(F.col("x")[0]).alias("first"), r6(vec.total(F.col("x"))).alias("total"))


@plans.add(f"WITH {_V}, {_KV} SELECT pos, CAST(layer AS INTEGER) AS layer, count(*) FILTER (role = 'key') * 8 AS numbers, round(max(CASE WHEN role = 'key' AND head = 1 THEN x[1] END), 6) AS ninth, round(max(CASE WHEN role = 'value' AND head = 0 THEN x[8] END), 6) AS v_eighth FROM kv GROUP BY 1, 2")
def nest_layers(spark, sf_dir):
    """A layer's vectors back in one list, heads within a token."""
    n = store.nest(kv_rows(spark, sf_dir), ["pos"])
    return n.select("pos", "layer", F.size("k").cast("bigint").alias("numbers"), r6(F.col("k")[8]).alias("ninth"), r6(F.col("v")[7]).alias("v_eighth"))


@plans.add(f"WITH {_V}, {_CHUNKS} SELECT l AS layer, r AS role, CAST(chunk AS BIGINT) AS chunk, tokens * 2 AS vectors, CAST(19 + tokens * 2 * 4 AS BIGINT) AS bytes FROM c, (VALUES (0), (1)) a(l), (VALUES ('key'), ('value')) b(r)")
def pool_build(spark, sf_dir):
    """Batches of the shared tier: 16-bit norms, two five-bit words a vector."""
    return store.build_pool(tokens(spark, sf_dir), SHAPE).select("layer", "role", "chunk", F.col("n_vectors").alias("vectors"), "bytes")


_BK8 = "bk AS (SELECT unnest(range(0, 32)) AS w, unnest([" + ",".join("[" + ",".join(f"{x!r}::DOUBLE" for x in w) + "]" for w in BOOK) + "]) AS word)"
_FIB8 = (
    f"kr AS (SELECT *, {rotated_sql('x', 8)} AS y, sqrt(list_inner_product(x, x)) AS nrm FROM kv), "
    "kb AS (SELECT pos, layer, head, role, b, list_transform(range(1, 5), lambda j: y[4*b+j] / nrm) AS s FROM (SELECT *, unnest(range(0, 2)) AS b FROM kr)), "
    "ka AS (SELECT pos, layer, head, role, b, min(struct_pack(d := round(list_sum(list_transform(range(1, 5), lambda j: (s[j]-word[j])*(s[j]-word[j]))), 12), w := w)) AS m FROM kb, bk GROUP BY 1, 2, 3, 4, 5), "
    "kw AS (SELECT pos, layer, head, role, flatten(list(word ORDER BY b)) AS z FROM ka JOIN bk ON bk.w = m.w GROUP BY 1, 2, 3, 4), "
    f"kd AS (SELECT kw.pos, kw.layer, kw.head, kw.role, x, list_transform({back_sql('z', 8)}, lambda a: a * CAST(CAST(nrm AS FLOAT) AS DOUBLE)) AS d FROM kw JOIN kr ON kr.pos = kw.pos AND kr.layer = kw.layer AND kr.head = kw.head AND kr.role = kw.role)"
)


@plans.add(f"WITH {_V}, {_KV}, {_BK8}, {_FIB8} SELECT CAST(layer AS INTEGER) AS layer, role, count(*) AS vectors, round(avg(list_sum(list_transform(range(1, 9), lambda i: (x[i]-d[i])*(x[i]-d[i]))) / 8), 6) AS mse, round(sum(list_inner_product(x, d)), 4) AS along FROM kd GROUP BY 1, 2")
def pool_decode(spark, sf_dir):
    """The pool read back: what the codebook loses, by layer and role."""
    blobs = store.build_pool(tokens(spark, sf_dir), SHAPE, "fib_k4_n32_batched_f32")
    at = ["layer", "role", "pos", "head"]
    back = store.decode_blobs(blobs, ["layer", "role"], SHAPE).withColumnRenamed("x", "d")
    met = kv_rows(spark, sf_dir).join(back, at)
    x, d = F.col("x"), F.col("d")
    return met.groupBy("layer", "role").agg(F.count("*").alias("vectors"), r6(F.avg(vec.mse(x, d))).alias("mse"), F.round(F.sum(vec.dot(x, d)), 4).alias("along"))


@plans.add(f"WITH {_V}, {_CHUNKS}, s AS (SELECT sum(tokens) AS tokens, sum(4 * (19 + tokens * 8)) AS bytes FROM c) SELECT 2 AS num_layers, CAST(tokens AS BIGINT) AS shared_tokens, CAST(bytes AS BIGINT) AS pool_bytes, CAST(tokens * 256 AS BIGINT) AS raw_bytes, round(tokens * 256 / bytes, 6) AS ratio, 'fib_k4_n32_batched' AS codec, true AS bound FROM s")
def pool_manifest(spark, sf_dir):
    """One row on the pool; its id binds layers, shape, codec and seed."""
    m = store.pool_manifest(store.build_pool(tokens(spark, sf_dir), SHAPE), SHAPE)
    bound = (F.length("pool_id") == 64) & (F.size("layer_digests") == 2)
    return m.select("num_layers", "shared_tokens", "pool_bytes", "raw_bytes", r6("ratio").alias("ratio"), "codec", bound.alias("bound"))


_OWN = "own AS (SELECT DISTINCT conv_id, turn, (conv_id * 7 + turn) % 50 AS id FROM conversations WHERE turn < 4 AND conv_id % 5 <> 0)"


def agents(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("agent_id")).distinct()


def own_tokens(spark, sf_dir):
    """Up to four own tokens an agent, none for every fifth."""
    t = table(spark, sf_dir, "conversations").where("turn < 4 and conv_id % 5 != 0").select("conv_id", "turn").distinct()
    t = t.select(F.col("conv_id").alias("agent_id"), "turn", ((F.col("conv_id") * 7 + F.col("turn")) % 50).alias("id"))
    met = t.join(vectors(spark, sf_dir).select("id", F.col("x").alias("vector")), "id")
    return store.positions(met, ["agent_id"], ["turn"]).select("agent_id", F.col("pos").cast("bigint").alias("pos"), "vector")


@plans.add(f"WITH {_OWN}, t AS (SELECT conv_id, count(*) AS n FROM own GROUP BY 1) SELECT a.conv_id AS agent_id, coalesce(n, 0) AS unique_tokens, CASE WHEN n IS NULL THEN 0 ELSE 2 END AS unique_layers, CAST(CASE WHEN n IS NULL THEN 0 ELSE 4 * (38 + 2 * n * 22) END AS BIGINT) AS shell_bytes, CASE WHEN n IS NULL THEN sha256('empty_shell:' || a.conv_id || ':pool') END AS empty_digest FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN t ON t.conv_id = a.conv_id")
def shell_manifests(spark, sf_dir):
    """A row per agent; agents without tokens of their own have an empty shell."""
    blobs = store.materialize_shells(own_tokens(spark, sf_dir), SHAPE)
    m = store.shell_manifests(agents(spark, sf_dir), blobs, "pool", SHAPE)
    return m.select("agent_id", "unique_tokens", "unique_layers", "shell_bytes", F.when(F.col("unique_tokens") == 0, F.col("shell_digest")).alias("empty_digest"))


@plans.add(f"WITH {_V}, {_KV}, {turbo_sql('kv', 'tk', 8, 3, single=True)}, b AS (SELECT pos, x, {back_sql('z', 8)} AS d FROM tk), {_OWN} SELECT conv_id AS agent_id, count(*) AS vectors, round(avg(list_sum(list_transform(range(1, 9), lambda i: (x[i]-d[i])*(x[i]-d[i]))) / 8), 6) AS mse FROM own JOIN b ON b.pos = own.id GROUP BY 1")
def shell_decode(spark, sf_dir):
    own = own_tokens(spark, sf_dir)
    back = store.decode_blobs(store.materialize_shells(own, SHAPE), ["agent_id", "layer", "role"], SHAPE).withColumnRenamed("x", "d")
    met = store.unnest(own, SHAPE).join(back, ["agent_id", "layer", "role", "pos", "head"])
    return met.groupBy("agent_id").agg(F.count("*").alias("vectors"), r6(F.avg(vec.mse(F.col("x"), F.col("d")))).alias("mse"))


@plans.add(f"WITH {_OWN} SELECT conv_id AS agent_id, CAST(4 AS BIGINT) AS blocks, CAST(2 AS BIGINT) AS layers, CAST(4 * (38 + 2 * count(*) * 22) AS BIGINT) AS bytes, CAST(4 AS BIGINT) AS traces FROM own GROUP BY 1")
def injection_receipts(spark, sf_dir):
    r = store.injection_receipts(store.materialize_shells(own_tokens(spark, sf_dir), SHAPE))
    return r.select("agent_id", "blocks", "layers", "bytes", F.size("traces").cast("bigint").alias("traces"))


@plans.add(f"WITH {_V}, {_OWN}, o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, id FROM own), g AS (SELECT conv_id, p.pos, o.id FROM (SELECT DISTINCT conv_id FROM own) a CROSS JOIN (SELECT unnest(range(0, 6)) AS pos) p LEFT JOIN o USING (conv_id, pos)) SELECT conv_id AS agent_id, CAST(pos AS BIGINT) AS pos, round(CASE WHEN g.id IS NOT NULL THEN w.x[1] WHEN pos < 5 THEN s.x[1] ELSE 0 END, 6) AS first FROM g LEFT JOIN v w ON w.id = g.id LEFT JOIN v s ON s.id = g.pos")
def overlay_store(spark, sf_dir):
    """Six positions an agent: its own tokens first, then five shared ones, then what was there."""
    own = own_tokens(spark, sf_dir)
    shells = store.unnest(own, SHAPE)
    pool = kv_rows(spark, sf_dir).where("pos < 5")
    grid = own.select("agent_id").distinct().select("agent_id", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")).alias("pos"))
    base = grid.select("agent_id", "pos", F.lit(0).alias("layer"), F.lit(0).alias("head"), F.lit("key").alias("role"), F.array_repeat(F.lit(0.0), 8).alias("x"))
    return store.overlay(base, pool, shells).select("agent_id", "pos", r6(F.col("x")[0]).alias("first"))


@plans.add(f"WITH {_OWN}, {_V} SELECT conv_id AS agent_id, CAST(8 + 21 + length(CAST(conv_id AS VARCHAR)) + 2 * 2 * 4 + count(*) * 256 AS BIGINT) AS bytes, CAST(2 AS BIGINT) AS layers, round(sum(list_sum(x)), 4) AS total FROM own JOIN v ON v.id = own.id GROUP BY 1")
def kv_binary(spark, sf_dir):
    """A file's bytes per agent and what is read back from them."""
    flat = store.nest(store.unnest(own_tokens(spark, sf_dir), SHAPE), ["agent_id", "pos"])
    side = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])).alias(c)
    files = pages.write_kv(flat.groupBy("agent_id", "layer").agg(side("k"), side("v")), "agent_id")
    back = pages.read_kv(files, "agent_id").groupBy("agent_id").agg(F.count_distinct("layer").alias("layers"), F.round(F.sum(vec.total(F.col("values"))), 4).alias("total"))
    return files.select("agent_id", F.octet_length("content").cast("bigint").alias("bytes")).join(back, "agent_id")


@plans.add(f"WITH {_V}, {_KV} SELECT role, count(*) AS vectors, round(avg(sqrt(list_inner_product(x, x))), 6) AS mean_norm, round(max(sqrt(list_inner_product(x, x))), 6) AS max_norm, count(*) FILTER (sqrt(list_inner_product(x, x)) > 0.5) AS outliers, CASE role WHEN 'key' THEN 'per_channel' ELSE 'per_token' END AS axis FROM kv GROUP BY role")
def kv_calibration(spark, sf_dir):
    c = store.calibration(kv_rows(spark, sf_dir), 0.5)
    return c.select("role", "vectors", r6("mean_norm").alias("mean_norm"), r6("max_norm").alias("max_norm"), "outliers", "axis")


@plans.add(
    f"WITH {_V}, {_CHUNKS}, s AS (SELECT sum(tokens) AS n, sum(2 * (38 + tokens * 2 * 22)) AS coded FROM c) SELECT * FROM (SELECT k AS component, 'raw_exact' AS profile, 'evaluated' AS status, CAST(n * 128 AS BIGINT) AS raw_bytes, CAST(n * 128 AS BIGINT) AS coded_bytes, 1.0::DOUBLE AS ratio, CAST(2 AS BIGINT) AS layers, true AS exact FROM s, (VALUES ('full_attn_k'), ('full_attn_v')) t(k) "
    "UNION ALL SELECT k, 'radii_preserved', 'evaluated', CAST(n * 128 AS BIGINT), CAST(coded AS BIGINT), round(n * 128 / coded, 6), CAST(2 AS BIGINT), false FROM s, (VALUES ('full_attn_k'), ('full_attn_v')) t(k) UNION ALL SELECT 'conv_state', 'radii_preserved', 'rejected', 0, 0, 0.0, 0, false)"
)
def component_calibration(spark, sf_dir):
    """Components under an exact and a lossy profile, by the codecs' own bytes and errors."""
    rows = kv_rows(spark, sf_dir)
    codecs = {"raw_exact": "exact_f32_fallback", "radii_preserved": "turbo_4bit_batched"}
    asked = [(c, p) for c in ("full_attn_k", "full_attn_v") for p in codecs] + [("conv_state", "radii_preserved")]
    out = None
    for component, profile in asked:
        one = store.calibrate_component(rows, component, profile, codecs[profile], SHAPE)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ratio", r6("ratio"))


# ---------------------------------------------------------------- paged tensors

PAGES = kvpages.PageProfile(16, protected=kvpages.Protected(first=2, last=1, heads=(1,)))
FIB8 = FibProfile(8)
_RAW = "(token < 2 OR token + 1 >= n OR head = 1)"
_BLK = f"t AS (SELECT count(*) AS n FROM v), bl AS (SELECT layer, head, pos AS token, pos // 16 AS page, {_RAW} AS raw, n FROM (SELECT *, pos AS token FROM kv WHERE role = 'key'), t)"


def key_blocks(spark, sf_dir):
    rows = kv_rows(spark, sf_dir).where("role = 'key'").select(F.lit(0).alias("batch"), "layer", "head", F.col("pos").cast("int").alias("token"), "x")
    shape = kvpages.TensorShape(1, 2, 2, vectors(spark, sf_dir).count(), 8)
    return rows, shape, kvpages.encode_tensor(rows, shape, PAGES, FIB8)


@plans.add(f"WITH {_V}, {_KV}, {_BLK} SELECT CAST(page AS INTEGER) AS page_id, CAST(min(token) AS INTEGER) AS token_start, CAST(count(DISTINCT token) AS INTEGER) AS token_count, count(*) AS blocks, count(*) FILTER (raw) AS raw_blocks, CAST(sum(CASE WHEN raw THEN 32 ELSE 15 END) AS BIGINT) AS bytes, '' AS broken FROM bl GROUP BY page")
def kv_pages(spark, sf_dir):
    """Pages of 16 tokens with what is coded, what is raw, and the rules that the stored pages break."""
    _, shape, blocks = key_blocks(spark, sf_dir)
    p = kvpages.pages_of(blocks, PAGES)
    broken = kvpages.page_violations(blocks, p, shape, PAGES)
    found = p.join(broken.select("page_id", F.array_join("violations", ",").alias("broken")), "page_id")
    return found.select("page_id", "token_start", "token_count", "blocks", "raw_blocks", "bytes", "broken")


@plans.add(f"WITH {_V}, {_KV}, {_BLK} SELECT CAST(layer AS INTEGER) AS layer, CAST(head AS INTEGER) AS head, CAST(token AS INTEGER) AS token, CAST((layer * 2 + head) * least(16, n - page * 16) + token - page * 16 AS INTEGER) AS block_id, CASE WHEN raw THEN 'protected_region' ELSE 'fib_quant_per_token' END AS reason, raw AS exact FROM bl")
def kv_roundtrip(spark, sf_dir):
    """Each vector's block, why it is coded or raw, and whether it comes back exactly."""
    rows, shape, blocks = key_blocks(spark, sf_dir)
    at = ["layer", "head", "token"]
    back = kvpages.decode_tensor(blocks, shape, FIB8).select(*at, F.col("x").alias("y"))
    met = blocks.select(*at, "block_id", "reason").join(rows, at).join(back, at)
    return met.select(*at, "block_id", "reason", (F.col("x") == F.col("y")).alias("exact"))


@plans.add(f"WITH {_V}, {_KV}, {_BLK} SELECT CAST(count(DISTINCT page) AS BIGINT) AS encoded_pages, count(*) FILTER (NOT raw) AS compressed_blocks, count(*) FILTER (raw) AS raw_blocks, 'protected_region' AS fallback_reasons, CAST(sum(CASE WHEN raw THEN 32 ELSE 15 END) AS BIGINT) AS bytes FROM bl")
def kv_receipt(spark, sf_dir):
    blocks = key_blocks(spark, sf_dir)[2]
    return kvpages.compression_receipt(blocks, kvpages.pages_of(blocks, PAGES)).withColumn("fallback_reasons", F.array_join("fallback_reasons", ","))


@plans.add("SELECT p_partkey AS id, CASE WHEN b < 2 AND l < 3 AND h < 4 AND t < 5 THEN CAST((((b * 3 + l) * 4 + h) * 5 + t) * 8 AS BIGINT) END AS at, '8,40,160,480,1' AS strides FROM (SELECT p_partkey, p_size % 3 AS b, p_size % 4 AS l, p_size % 5 AS h, p_size % 6 AS t FROM part)")
def vector_offsets(spark, sf_dir):
    """Places of vectors in a flat tensor of 2 x 3 x 4 x 5 x 8; null outside."""
    shape, size = kvpages.TensorShape(2, 3, 4, 5, 8), F.col("p_size")
    s = kvpages.strides(shape)
    text = ",".join(str(s[n]) for n in ("token", "head", "layer", "batch", "dim"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kvpages.vector_offset(shape, size % 3, size % 4, size % 5, size % 6).alias("at"), F.lit(text).alias("strides"))


# ---------------------------------------------------------------- coded caches

TURBO = TurboProfile(D, 4, 32)
_FQ = "fq AS (SELECT label, min(id) AS qid FROM v GROUP BY label)"
_SCORES = f"{_TB4.replace('SELECT id, x, y, z, r,', 'SELECT id, label, x, y, z, r,')}, {_FQ}, lg AS (SELECT c.label, c.id, round({_EST} * 0.125::DOUBLE, 9) AS score, round(list_inner_product(q.x, c.x) * 0.125::DOUBLE, 9) AS exact FROM pr c JOIN fq ON fq.label = c.label JOIN pr q ON q.id = fq.qid)"


def cache(spark, sf_dir, keep_shadow=True):
    v = vectors(spark, sf_dir)
    rows = v.select(F.col("label").cast("bigint").alias("ctx"), F.col("id").alias("pos"), F.col("x").alias("key"), F.col("x").alias("value"))
    asked = v.groupBy(F.col("label").cast("bigint").alias("ctx")).agg(F.min_by("x", "id").alias("q"))
    return kvcache.compress(rows, TURBO, keep_shadow), asked


@plans.add(f"{_SCORES} SELECT CAST(label AS BIGINT) AS ctx, id AS pos, round(score, 6) AS score, round(exact, 6) AS exact, round(abs(exact - score), 6) AS error FROM lg")
def cache_scores(spark, sf_dir):
    """Scaled scores on coded keys beside the exact ones."""
    kept, asked = cache(spark, sf_dir)
    e = kvcache.estimate_errors(kvcache.scores(kept, asked, TURBO, "head_dim"))
    return e.select("ctx", "pos", *[r6(c).alias(c) for c in ("score", "exact", "error")])


@plans.add(f"{_SCORES}, {turbo_sql('v', 'tv', D, 3, seed=43)}, dv AS (SELECT id, {back_sql('z', D, 43)} AS d FROM tv), mx AS (SELECT label, max(score) AS top FROM lg GROUP BY label), sm AS (SELECT lg.label, lg.id, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY lg.label) AS p FROM lg JOIN mx ON mx.label = lg.label) SELECT CAST(label AS BIGINT) AS ctx, CAST(i AS INTEGER) AS dim, round(sum(p * d[i+1]), 6) AS value FROM (SELECT label, p, d, unnest(range(0, {D})) AS i FROM sm JOIN dv ON dv.id = sm.id) GROUP BY 1, 2")
def cache_attend(spark, sf_dir):
    """Attention on codes alone: coded keys give the weights, decoded values the sum."""
    kept, asked = cache(spark, sf_dir, keep_shadow=False)
    return kvcache.attend(kept, asked, TURBO, "head_dim").select("ctx", "dim", r6("value").alias("value"))


@plans.add(f"WITH {_V}, {turbo_sql('v', 'tv', D, 3, seed=43)}, dv AS (SELECT id, label, {back_sql('z', D, 43)} AS d FROM tv) SELECT CAST(label AS BIGINT) AS ctx, id AS pos, round(d[1], 6) AS first, round(list_sum(d), 6) AS total FROM dv WHERE id % 7 = 0")
def cache_values(spark, sf_dir):
    kept, _ = cache(spark, sf_dir, keep_shadow=False)
    v = kvcache.values(kept, TURBO, kept.where("pos % 7 = 0").select("ctx", "pos"))
    return v.select("ctx", "pos", r6(F.col("value")[0]).alias("first"), r6(vec.total(F.col("value"))).alias("total"))


@plans.add("SELECT count(*) AS tokens, count(*) * 144 AS key_bytes, count(*) * 144 AS value_bytes, count(*) * 256 AS shadow_key_bytes, count(*) * 256 AS shadow_value_bytes, count(*) * 512 AS raw_bytes, count(*) * 256 AS fp16_bytes, count(*) * 800 AS resident_bytes, count(*) * 288 AS sidecar_bytes, round(512 / 288::DOUBLE, 6) AS ratio FROM embeddings")
def cache_memory(spark, sf_dir):
    m = kvcache.memory_report(cache(spark, sf_dir)[0], TURBO)
    return m.withColumn("ratio", r6("ratio"))


@plans.add(f"WITH {_V} SELECT id, round(list_max(l) + ln(list_sum(list_transform(l, lambda a: exp(a - list_max(l))))) - l[label + 1], 6) AS nll FROM (SELECT id, label, list_transform(x, lambda a: a * 10) AS l FROM v)")
def token_nll(spark, sf_dir):
    """Loss of a target among the logits of a position."""
    logits = vec.scale(F.col("x"), F.lit(10.0))
    return vectors(spark, sf_dir).select("id", r6(kvcache.nll(logits, F.col("label"))).alias("nll"))


@plans.add("WITH n AS (SELECT p_partkey AS id, p_size - 1 AS n FROM part), s AS (SELECT id, n, greatest(1, least(n - 1, n * 3 // 4)) AS b FROM n) SELECT id, CASE WHEN n <= 1 THEN '' WHEN n - 1 - b <= 0 THEN CAST(n - 1 AS VARCHAR) ELSE array_to_string(list_sort(list_distinct([CAST(b + round_even((n - 1 - b) * i / 3::DOUBLE, 0) AS BIGINT) for i in [0, 1, 2, 3]] || [CAST(n - 1 AS BIGINT)])), ',') END AS positions FROM s")
def query_positions(spark, sf_dir):
    """Four positions in the last quarter of each length."""
    at = kvcache.query_positions(F.col("p_size") - 1, 0.75, 4)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(at, lambda i: i.cast("string")), ",").alias("positions"))


