"""State queries: pages, lineage, leases, policies, streams; orders and parts stand in for states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import state
from ..shared import deal
from ..sources.tables import table
from .common import Plans

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles
T = table

# ---------------------------------------------------------------- pages and documents


@plans.add("SELECT sha256(html) AS digest, count(*) AS copies, min(page_id) AS first_page, CAST(max(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def page_dedup(spark, sf_dir):
    p = T(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n"))
    return p.groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first_page"), F.max("n").cast("bigint").alias("bytes"))


@plans.add("WITH d AS (SELECT sha256(text) AS h, max(strlen(text)) AS n, count(*) AS c FROM documents GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS uniques, CAST(sum(n * c) AS BIGINT) AS logical, CAST(sum(n) AS BIGINT) AS physical, CAST(sum(n * (c - 1)) AS BIGINT) AS saved FROM d")
def dedup_stats(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.octet_length("text").cast("bigint").alias("n"))
    d = d.groupBy("h").agg(F.max("n").alias("n"), F.count("*").alias("c"))
    n, c = F.col("n"), F.col("c")
    return d.agg(F.sum(c).alias("total"), F.count("*").alias("uniques"), F.sum(n * c).alias("logical"), F.sum(n).alias("physical"), F.sum(n * (c - 1)).alias("saved"))


@plans.add("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'corrupted' ELSE 'valid' END AS status FROM pages")
def page_verify(spark, sf_dir):
    """Every seventh payload is damaged on the way in; the digest check has to find exactly those."""
    p = T(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")).alias("payload"))
    return p.select("page_id", F.when(F.sha2("payload", 256) == F.col("digest"), "valid").otherwise("corrupted").alias("status"))


@plans.add("SELECT d.doc_id, min(e.doc_id) AS cached FROM documents d JOIN documents e ON e.text = d.text GROUP BY d.doc_id")
def doc_hash_lookup(spark, sf_dir):
    d = T(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("cached")), "h").select("doc_id", "cached")


@plans.add("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, sha256(string_agg(text, '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def rag_graft(spark, sf_dir):
    """Ordered concatenation of the texts of a conversation."""
    c = T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    return c.select("conv_id", "turns", "chars", F.sha2(F.array_join("all.text", "|"), 256).alias("digest"))


@plans.add("SELECT conv_id, CAST(turn // 4 AS BIGINT) AS page, count(*) AS tokens, count(*) FILTER (turn < 1 OR role = 'system') AS raw FROM conversations GROUP BY 1, 2")
def paged_encode_counts(spark, sf_dir):
    c = T(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", F.floor(F.col("turn") / 4).alias("page")).agg(F.count("*").alias("tokens"), F.count_if((F.col("turn") < 1) | (F.col("role") == "system")).alias("raw"))


@plans.add("SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) END) AS BIGINT) AS k, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) END) AS BIGINT) AS v FROM conversations GROUP BY conv_id")
def pivot_kv_pairs(spark, sf_dir):
    c = T(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("bigint"))
    return c.groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.sum("n")).select("conv_id", F.col("user").alias("k"), F.col("assistant").alias("v"))


@plans.add("SELECT c.conv_id, c.turn, count(e.vec_id) > 0 AS pooled, CASE WHEN count(e.vec_id) > 0 THEN CAST(max(e.label) AS BIGINT) ELSE -1 END AS source FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN embeddings e ON e.vec_id = c.turn AND c.turn < 3 GROUP BY 1, 2")
def overlay_pool_shell(spark, sf_dir):
    """Positions below 3 come from the shared pool, later ones from the agent's shell."""
    c = T(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    pool = T(spark, sf_dir, "embeddings").where("vec_id < 3").select(F.col("vec_id").alias("turn"), F.col("label").cast("bigint").alias("source"))
    pool = pool.groupBy("turn").agg(F.max("source").alias("source"))
    return c.join(pool, "turn", "left").select("conv_id", "turn", F.col("source").isNotNull().alias("pooled"), F.coalesce("source", F.lit(-1)).alias("source"))


# ---------------------------------------------------------------- lineage

_ST = "st AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey >= 4 THEN o_orderkey // 4 END AS parent, o_orderstatus = 'F' AS released FROM orders), ids AS (SELECT DISTINCT id FROM st), own AS (SELECT st.id, CASE WHEN ids.id IS NOT NULL THEN parent END AS parent, released FROM st LEFT JOIN ids ON ids.id = st.parent)"


def states(spark, sf_dir) -> DataFrame:
    o = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") >= 4, F.floor(F.col("o_orderkey") / 4)).alias("parent"), (F.col("o_orderstatus") == "F").alias("released"))
    return state.checked_parents(o)


@plans.add(f"WITH RECURSIVE {_ST}, up AS (SELECT id, parent AS anc, 1 AS depth FROM own WHERE parent IS NOT NULL UNION ALL SELECT up.id, own.parent, depth + 1 FROM up JOIN own ON own.id = up.anc WHERE own.parent IS NOT NULL) SELECT id, anc AS ancestor, CAST(depth AS BIGINT) AS depth FROM up")
def fork_lineage(spark, sf_dir):
    return state.ancestors(states(spark, sf_dir))


@plans.add(f"WITH RECURSIVE {_ST}, kid AS (SELECT parent, min(id) AS first FROM own WHERE parent IS NOT NULL GROUP BY parent), walk AS (SELECT id AS root, id, 0 AS step FROM own WHERE parent IS NULL UNION ALL SELECT root, kid.first, step + 1 FROM walk JOIN kid ON kid.parent = walk.id) SELECT root, id, CAST(step AS BIGINT) AS step FROM walk")
def branch_walk(spark, sf_dir):
    return state.first_children(states(spark, sf_dir))


@plans.add(f"WITH RECURSIVE {_ST}, live AS (SELECT id FROM own WHERE NOT released UNION SELECT own.id FROM live JOIN own ON own.parent = live.id) SELECT id, id IN (SELECT id FROM live) AS reachable FROM own")
def gc_reachable(spark, sf_dir):
    s = states(spark, sf_dir)
    live = state.reachable(s)
    return s.join(live.withColumn("reachable", F.lit(True)), "id", "left").select("id", F.coalesce("reachable", F.lit(False)).alias("reachable"))


@plans.add(f"WITH RECURSIVE {_ST}, live AS (SELECT id FROM own WHERE NOT released UNION SELECT own.id FROM live JOIN own ON own.parent = live.id), pg AS (SELECT DISTINCT l_orderkey AS id, l_partkey * 100000 + l_suppkey AS page FROM lineitem) SELECT DISTINCT page FROM pg WHERE id IN (SELECT id FROM own) AND id NOT IN (SELECT id FROM live) AND page NOT IN (SELECT page FROM pg JOIN live USING (id))")
def gc_collect(spark, sf_dir):
    """Pages of unreachable states that no reachable state refers to."""
    pages = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("page"))
    rows = pages.count()
    return state.collectable(states(spark, sf_dir), deal(pages, rows, "id").distinct(), rows)


@plans.add(f"WITH RECURSIVE {_ST}, up AS (SELECT id AS sess, id AS anc, 0 AS depth FROM own WHERE id % 4 = 1 UNION ALL SELECT sess, own.parent, depth + 1 FROM up JOIN own ON own.id = up.anc WHERE own.parent IS NOT NULL) SELECT anc AS id, min(sess) AS first_session, CAST(max(depth) AS BIGINT) AS deepest FROM up GROUP BY anc")
def agent_replay(spark, sf_dir):
    """States replayed for the sessions that sit on first children: each once, with its first session."""
    s = states(spark, sf_dir)
    return state.replayed(s, s.where("id % 4 = 1").select("id"))


_PARTS = "pg AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 50 AS page FROM lineitem), sz AS (SELECT id, count(*) AS n FROM pg GROUP BY id)"


@plans.add(f"WITH {_ST}, {_PARTS}, cm AS (SELECT own.id, own.parent, count(b.page) AS common FROM own JOIN pg a ON a.id = own.id LEFT JOIN pg b ON b.id = own.parent AND b.page = a.page WHERE parent IS NOT NULL GROUP BY own.id, own.parent) SELECT cm.id, cm.parent, round((greatest(x.n, y.n) - common) / greatest(x.n, y.n), 6) AS difference, (greatest(x.n, y.n) - common) / greatest(x.n, y.n) <= 0.8 AS reusable FROM cm JOIN sz x ON x.id = cm.id JOIN sz y ON y.id = cm.parent")
def fork_similarity(spark, sf_dir):
    pages, rows = _pages(spark, sf_dir)
    return state.similarity(states(spark, sf_dir), pages, 0.8, rows)


def _pages(spark, sf_dir):
    """(id, page), each once, and how many rows there are at most; dealt by id."""
    p = T(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).alias("page"))
    rows = p.count()
    return deal(p, rows, "id").distinct(), rows


@plans.add(f"WITH {_ST}, {_PARTS}, e AS (SELECT own.id, own.parent FROM own WHERE parent IS NOT NULL AND parent IN (SELECT id FROM pg)), a AS (SELECT e.id, pg.page, 'added' AS change FROM e JOIN pg ON pg.id = e.id WHERE NOT EXISTS (SELECT 1 FROM pg p WHERE p.id = e.parent AND p.page = pg.page) UNION ALL SELECT e.id, pg.page, 'removed' FROM e JOIN pg ON pg.id = e.parent WHERE NOT EXISTS (SELECT 1 FROM pg p WHERE p.id = e.id AND p.page = pg.page)) SELECT * FROM a")
def state_delta(spark, sf_dir):
    pages, rows = _pages(spark, sf_dir)
    edges = states(spark, sf_dir).where("parent is not null").select("id", "parent")
    edges = deal(edges, rows, "parent").join(pages.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    return state.delta(edges, pages, rows)


# ---------------------------------------------------------------- policies and leases

_LEASE = "ls AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN 'other' ELSE 'owner' END AS principal, c_custkey % 11 <> 0 AS same_state, c_acctbal AS expires, c_nationkey AS epoch, c_custkey % 8 AS rights FROM customer)"


def leases(spark, sf_dir):
    return T(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 == 0, "other").otherwise("owner").alias("principal"), (F.col("c_custkey") % 11 != 0).alias("same_state"),
        F.col("c_acctbal").alias("expires"), F.col("c_nationkey").alias("epoch"), (F.col("c_custkey") % 8).alias("rights"),
    )


@plans.add(f"WITH {_LEASE} SELECT id, CASE WHEN principal <> 'owner' THEN 'PrincipalMismatch' WHEN NOT same_state THEN 'StateMismatch' WHEN 1000 >= expires THEN 'Expired' WHEN 12 > epoch THEN 'Revoked' WHEN rights & 2 = 0 THEN 'MissingRight' ELSE 'Active' END AS status FROM ls")
def lease_status(spark, sf_dir):
    return leases(spark, sf_dir).select("id", state.lease_status(now=1000, epoch=12, right=2).alias("status"))


@plans.add(f"WITH {_LEASE} SELECT id, rights & 1 <> 0 AS can_read, CAST(rights | 4 AS BIGINT) AS with_fork, CAST(rights & ~2 AS BIGINT) AS without_write FROM ls")
def lease_rights(spark, sf_dir):
    r = F.col("rights")
    return leases(spark, sf_dir).select("id", (r.bitwiseAND(F.lit(1)) != 0).alias("can_read"), r.bitwiseOR(F.lit(4)).cast("bigint").alias("with_fork"), r.bitwiseAND(F.lit(~2)).cast("bigint").alias("without_write"))


@plans.add("SELECT event_id, value <= 50 AND event_type <> 'error' AS reusable FROM events")
def reuse_policy(spark, sf_dir):
    """Reusable if active and young enough."""
    return T(spark, sf_dir, "events").select("event_id", ((F.col("value") <= 50) & (F.col("event_type") != "error")).alias("reusable"))


@plans.add("SELECT conv_id, turn, CASE WHEN turn < 1 OR role = 'system' THEN 'raw:protected' WHEN length(text) < 20 THEN 'raw:uncalibrated' WHEN role = 'user' THEN 'per_channel' ELSE 'per_token' END AS decision, count(*) AS n FROM conversations GROUP BY 1, 2, 3")
def compression_decision(spark, sf_dir):
    c = T(spark, sf_dir, "conversations")
    protected = (F.col("turn") < 1) | (F.col("role") == "system")
    return c.groupBy("conv_id", "turn", state.compression(protected, F.length("text") >= 20, F.col("role") == "user").alias("decision")).agg(F.count("*").alias("n"))


@plans.add("WITH l AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, count(*) AS tokens, count(*) FILTER (turn < 2 OR turn + 1 > last) AS protected FROM l GROUP BY conv_id")
def protected_tokens(spark, sf_dir):
    """First two and last positions of each conversation."""
    c = T(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    return c.groupBy("conv_id").agg(F.count("*").alias("tokens"), F.count_if((F.col("turn") < 2) | (F.col("turn") + 1 > F.col("last"))).alias("protected"))


@plans.add("SELECT p_type AS kind, p_size % 3 AS requested, CASE WHEN p_size % 3 = 0 THEN 'raw' WHEN starts_with(p_type, 'STANDARD') AND p_size % 3 = 1 THEN 'turbo' WHEN p_size % 3 = 2 AND NOT starts_with(p_type, 'ECONOMY') THEN 'fib' ELSE 'raw:not_admitted' END AS codec, count(*) AS n FROM part GROUP BY 1, 2, 3")
def codec_admission(spark, sf_dir):
    p = T(spark, sf_dir, "part")
    ask = F.col("p_size") % 3
    codec = F.when(ask == 0, "raw").when(F.col("p_type").startswith("STANDARD") & (ask == 1), "turbo").when((ask == 2) & ~F.col("p_type").startswith("ECONOMY"), "fib").otherwise("raw:not_admitted")
    return p.groupBy(F.col("p_type").alias("kind"), ask.alias("requested"), codec.alias("codec")).agg(F.count("*").alias("n"))


@plans.add("SELECT p_partkey AS id, CAST(regexp_extract(c, '_([0-9]+)bit', 1) AS BIGINT) AS bits, starts_with(c, 'turbo') AS turbo, ends_with(c, '_lossy') AS lossy, regexp_full_match(c, '(turbo|fib)_[0-9]+bit(_lossy)?') AND CAST(regexp_extract(c, '_([0-9]+)bit', 1) AS BIGINT) BETWEEN 2 AND 16 AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'turbo' ELSE 'fib' END || '_' || (p_size % 20) || 'bit' || CASE WHEN p_partkey % 3 = 0 THEN '_lossy' ELSE '' END AS c FROM part)")
def codec_id_parse(spark, sf_dir):
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "turbo").otherwise("fib"), F.lit("_"), (F.col("p_size") % 20).cast("string"), F.lit("bit"), F.when(F.col("p_partkey") % 3 == 0, "_lossy").otherwise(""))
    return T(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("c")).select("id", *state.parse_codec("c"))


@plans.add("SELECT user_id, count(*) AS held, CAST(sum(value) > 4000 AS BIGINT) AS over_bytes, CASE WHEN count(*) > 80 THEN 'too_many' WHEN sum(value) > 4000 THEN 'too_large' ELSE 'ok' END AS verdict FROM events GROUP BY user_id")
def resource_limits(spark, sf_dir):
    e = T(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("held"), F.sum("value").alias("v"))
    over = F.col("v") > 4000
    return e.select("user_id", "held", over.cast("bigint").alias("over_bytes"), F.when(F.col("held") > 80, "too_many").when(over, "too_large").otherwise("ok").alias("verdict"))


@plans.add("SELECT s_suppkey AS id, CAST(s_nationkey * 64 * 2 AS BIGINT) AS elements, CAST(s_nationkey * 64 * 2 * 4 AS BIGINT) AS bytes, s_nationkey > 0 AND (s_nationkey % 2 = 0 OR s_nationkey < 12) AS valid FROM supplier")
def shape_contracts(spark, sf_dir):
    n = F.col("s_nationkey").cast("bigint")
    return T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (n * 64 * 2).alias("elements"), (n * 64 * 2 * 4).alias("bytes"), ((n > 0) & ((n % 2 == 0) | (n < 12))).alias("valid"))


# ---------------------------------------------------------------- windows and streams


@plans.add("WITH o AS (SELECT user_id, event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS win FROM events) SELECT user_id, CAST(win AS BIGINT) AS win, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS total FROM o GROUP BY 1, 2")
def context_windows(spark, sf_dir):
    """Tumbling count windows of 8 per user; the last may be partial."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    o = T(spark, sf_dir, "events").select("user_id", "event_id", "value", F.floor(n / 8).alias("win"))
    return o.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.round(F.sum("value"), 4).alias("total"))


@plans.add("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """Every delivery sent twice; intake by sequence number keeps one of each."""
    from ..streaming import intake

    return intake.deduplicated(spark, sf_dir)


@plans.add("SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events GROUP BY event_type")
def stream_snapshots(spark, sf_dir):
    from ..streaming import intake

    return intake.snapshots(spark, sf_dir)
