"""Requests to the state store and what becomes of them; orders stand in for states, customers for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state, statestore
from ..sources.tables import table
from .common import Plans
from .state_queries import _ST, states

plans = Plans()
QUERIES, ORACLES = plans.queries, plans.oracles
T = table
C = F.col


def requests(spark, sf_dir, **columns):
    return T(spark, sf_dir, "customer").select(*[c.alias(n) for n, c in columns.items()])


_ONE = "(SELECT id, bool_or(released) AS released FROM own GROUP BY id)"


@plans.add(f"WITH {_ST}, r AS (SELECT c_custkey * 3 AS id, c_custkey AS parent FROM customer) SELECT r.id, r.parent, CASE WHEN p.id IS NULL THEN 'parent_missing' WHEN p.released THEN 'parent_released' WHEN x.id IS NOT NULL THEN 'exists' ELSE 'ok' END AS verdict FROM r LEFT JOIN {_ONE} p ON p.id = r.parent LEFT JOIN {_ONE} x ON x.id = r.id")
def fork_requests(spark, sf_dir):
    """Forks of existing states into new ids; a parent has to exist and be live."""
    return statestore.fork(states(spark, sf_dir), requests(spark, sf_dir, id=C("c_custkey") * 3, parent=C("c_custkey")))


@plans.add(f"WITH {_ST}, r AS (SELECT c_custkey * 3 AS id, c_custkey AS parent FROM customer), ok AS (SELECT r.id FROM r JOIN {_ONE} p ON p.id = r.parent AND NOT p.released WHERE r.id NOT IN (SELECT id FROM own)) SELECT count(*) AS states, count(*) FILTER (released) AS released, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS leases FROM (SELECT released FROM own UNION ALL SELECT false FROM ok)")
def store_counts(spark, sf_dir):
    """The store after the forks of fork_requests."""
    s = states(spark, sf_dir)
    after = statestore.with_forks(s, statestore.fork(s, requests(spark, sf_dir, id=C("c_custkey") * 3, parent=C("c_custkey"))))
    return statestore.counts(after, requests(spark, sf_dir, lease_id=C("c_custkey")).where("lease_id % 2 = 0"))


@plans.add(f"WITH {_ST}, r AS (SELECT DISTINCT c_custkey * 2 AS id FROM customer) SELECT r.id, CASE WHEN id IN (SELECT id FROM own) THEN 'exists' ELSE 'ok' END AS verdict FROM r")
def commit_roots(spark, sf_dir):
    return statestore.commit_roots(states(spark, sf_dir), requests(spark, sf_dir, id=C("c_custkey") * 2))


@plans.add(f"WITH {_ST}, r AS (SELECT c_custkey % 500 AS lease_id, min(c_custkey) AS first FROM customer GROUP BY 1), a AS (SELECT c_custkey % 500 AS lease_id, c_custkey AS state_id FROM customer) SELECT a.lease_id, a.state_id, CASE WHEN a.lease_id % 10 = 0 OR a.state_id <> r.first THEN 'registered' WHEN p.id IS NULL THEN 'state_missing' WHEN p.released THEN 'state_released' ELSE 'ok' END AS verdict FROM a JOIN r ON r.lease_id = a.lease_id LEFT JOIN {_ONE} p ON p.id = a.state_id")
def lease_register(spark, sf_dir):
    """Leases on states: an id is registered once, its state exists and is live."""
    asked = requests(spark, sf_dir, lease_id=C("c_custkey") % 500, state_id=C("c_custkey"))
    held = asked.where("lease_id % 10 = 0").select("lease_id").distinct()
    return statestore.register_leases(states(spark, sf_dir), held, asked)


@plans.add("SELECT lease_id, CASE WHEN lease_id % 2 = 0 THEN 'ok' ELSE 'missing' END AS verdict, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS stay FROM (SELECT c_custkey AS lease_id FROM customer WHERE c_custkey % 3 = 0)")
def lease_revoke(spark, sf_dir):
    held = requests(spark, sf_dir, lease_id=C("c_custkey")).where("lease_id % 2 = 0")
    stay, verdict = statestore.revoke_leases(held, requests(spark, sf_dir, lease_id=C("c_custkey")).where("lease_id % 3 = 0"))
    return verdict.crossJoin(stay.agg(F.count("*").alias("stay")))  # one row


@plans.add(f"WITH {_ST} SELECT own.id, released OR id % 5 = 0 AS released FROM own")
def state_release(spark, sf_dir):
    s = states(spark, sf_dir)
    return statestore.release(s, s.where("id % 5 = 0").select("id")).select("id", "released")


@plans.add(f"WITH RECURSIVE {_ST}, leased AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 9 = 0), rt AS (SELECT own.id, parent, released AND own.id NOT IN (SELECT id FROM leased) AS dead FROM own), live AS (SELECT id FROM rt WHERE NOT dead UNION SELECT rt.id FROM live JOIN rt ON rt.parent = live.id) SELECT id, id IN (SELECT id FROM live) AS reachable FROM own")
def gc_with_leases(spark, sf_dir):
    """Roots of collection are states that are not released, and those that a lease holds."""
    s = states(spark, sf_dir)
    held = requests(spark, sf_dir, state_id=C("c_custkey")).where("state_id % 9 = 0")
    live = state.reachable(statestore.rooted(s, held)).withColumn("reachable", F.lit(True))
    return s.select("id").join(live, "id", "left").select("id", F.coalesce("reachable", F.lit(False)).alias("reachable"))


@plans.add(f"WITH {_ST} SELECT own.id, own.parent, CASE WHEN own.parent // 4 > 0 THEN (own.parent // 4) || '>' || own.parent ELSE CAST(own.parent AS VARCHAR) END AS lineage FROM own WHERE parent IS NOT NULL")
def branch_lineage(spark, sf_dir):
    """A branch's lineage: its parent's with the parent appended; here each manifest knows one ancestor."""
    s = states(spark, sf_dir).select("id", "parent").distinct()
    up = F.floor(C("id") / 4)
    m = s.select("id", F.when(up > 0, F.array(up)).otherwise(F.array().cast("array<bigint>")).alias("parent_lineage"))
    b = statestore.branch(m, s.where("parent is not null"))
    return b.select("id", "parent", F.array_join(F.transform("parent_lineage", lambda i: i.cast("string")), ">").alias("lineage"))


@plans.add("SELECT c_custkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN 'lease principal mismatch' WHEN c_custkey % 11 = 0 THEN 'lease state mismatch' WHEN 1000 >= c_acctbal THEN 'lease expired' WHEN 12 > c_nationkey THEN 'lease revoked' WHEN c_custkey % 8 & 4 = 0 THEN 'lease missing required right' END AS refusal FROM customer")
def fork_authorization(spark, sf_dir):
    """Why forks under leases are refused; null where they are allowed."""
    from .state_queries import leases

    return leases(spark, sf_dir).select("id", statestore.refusal(state.lease_status(now=1000, epoch=12, right=statestore.FORK)).alias("refusal"))


@plans.add("SELECT c_custkey AS nonce, 'lease-v1:' || sha256(c_name || '|space|run|node|1|' || (c_custkey % 100) || '|3|' || CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE CAST(c_nationkey * 1000 AS VARCHAR) END || '|7|' || c_custkey || '|5000') AS lease_id, CAST(5000 AS BIGINT) AS issued, CASE WHEN c_custkey % 4 <> 0 THEN CAST(5000 + c_nationkey * 1000 AS BIGINT) END AS expires FROM customer")
def lease_issue(spark, sf_dir):
    """Leases with and without a time to live."""
    ttl = F.when(C("c_custkey") % 4 != 0, C("c_nationkey") * 1000)
    asked = requests(spark, sf_dir, principal=C("c_name"), namespace=F.lit("space"), run_id=F.lit("run"), node_id=F.lit("node"), attempt=F.lit(1), state_id=C("c_custkey") % 100, rights=F.lit(3), ttl=ttl, epoch=F.lit(7), nonce=C("c_custkey"))
    issued = statestore.issue_leases(asked, 5000)
    bound = statestore.lease_id(5000)
    return asked.select("nonce", bound.alias("lease_id")).join(issued.select("lease_id", "issued", "expires"), "lease_id").select("nonce", "lease_id", "issued", "expires")


@plans.add(f"WITH {_ST}, s AS (SELECT CAST(id // 1000 AS BIGINT) AS bucket, count(DISTINCT id) AS states, sha256(string_agg(DISTINCT id, ',' ORDER BY id)) AS digest FROM own GROUP BY 1), l AS (SELECT CAST(c_custkey // 1000 AS BIGINT) AS bucket, count(*) AS leases FROM customer GROUP BY 1) SELECT s.bucket, states, coalesce(leases, 0) AS leases, digest FROM s LEFT JOIN l ON l.bucket = s.bucket")
def store_snapshot(spark, sf_dir):
    """Sorted ids by range, digested, with the leases of the range."""
    return statestore.snapshot(states(spark, sf_dir), requests(spark, sf_dir, state_id=C("c_custkey")))


@plans.add("SELECT l_orderkey AS workflow_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS step, l_partkey AS state_id FROM lineitem")
def workflow_resume(spark, sf_dir):
    """Steps of workflows from their checkpoints, in order."""
    steps = T(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("workflow_id"), C("l_linenumber").alias("step"), C("l_partkey").alias("state_id"))
    return statestore.resume(statestore.checkpoints(steps))


@plans.add("SELECT doc_id AS call, sha256(text) AS before_hash, CASE WHEN doc_id % 3 <> 0 THEN sha256(upper(source)) END AS after_hash, doc_id % 3 <> 0 AS complete FROM documents WHERE text IS NOT NULL")
def tool_sessions(spark, sf_dir):
    """What a tool saw and left; a call without an after state is not complete."""
    d = T(spark, sf_dir, "documents").where("text is not null")
    return statestore.tool_sessions(d.select(C("doc_id").alias("call"), C("text").alias("before"), F.when(C("doc_id") % 3 != 0, F.upper("source")).alias("after")))


@plans.add("SELECT event_id AS sequence, event_type AS payload, event_id % 4 <> 1 AS first FROM events WHERE event_id % 3 <> 0")
def deliveries(spark, sf_dir):
    """Deliveries queued twice and partly acknowledged: what is received, and whether an acknowledgement is new."""
    e = T(spark, sf_dir, "events").select(C("event_id").alias("sequence"), C("event_type").alias("payload"))
    got = statestore.admitted(e.unionByName(e), e.where("sequence % 3 = 0"))
    _, first = statestore.acknowledge(e.where("sequence % 3 = 0 or sequence % 4 = 1"), got)
    return got.join(first, "sequence")


@plans.add(f"WITH {_ST}, s AS (SELECT user_id AS scope, max(event_id) AS sequence FROM events GROUP BY 1) SELECT scope, sequence, sequence AS state_id FROM s WHERE sequence % 4 <> 0 AND sequence IN (SELECT id FROM own)")
def standby_resume(spark, sf_dir):
    """Each scope's latest snapshot, if it verifies and its state exists."""
    e, i = T(spark, sf_dir, "events"), C("event_id")
    kept = e.select(C("user_id").alias("scope"), i.alias("sequence"), i.alias("state_id"), F.sha2(F.when(i % 4 == 0, F.lit("damaged")).otherwise(i.cast("string")), 256).alias("digest"))
    return statestore.standby(kept, states(spark, sf_dir))


@plans.add("WITH e AS (SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS at_s FROM events), s AS (SELECT *, (at_s - min(at_s) OVER (PARTITION BY user_id)) // 86400 AS slot FROM e) SELECT user_id AS scope, event_id AS event, row_number() OVER (PARTITION BY user_id, slot ORDER BY at_s, event_id) = 1 AS taken FROM s")
def snapshot_schedule(spark, sf_dir):
    """A snapshot a day of each user's own clock, in seconds; a fraction goes to the nearest second, as in SQL, halves to the even one."""
    at = F.rint(F.unix_micros(C("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    return statestore.due(T(spark, sf_dir, "events").select(C("user_id").alias("scope"), at.alias("at"), C("event_id").alias("event")), 86_400)


_PP = "pg AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 20 AS page FROM lineitem), sz AS (SELECT id, count(*) AS n FROM pg GROUP BY id), mf AS (SELECT o_orderkey AS id, o_orderpriority AS model, min(o_orderkey) OVER (PARTITION BY o_orderkey) AS one FROM orders)"


@plans.add(f"WITH {_PP}, pr AS (SELECT DISTINCT id AS requested, id - 1 AS existing FROM mf WHERE id - 1 IN (SELECT id FROM mf)), cm AS (SELECT requested, existing, count(b.page) AS common FROM pr LEFT JOIN pg a ON a.id = requested LEFT JOIN pg b ON b.id = existing AND b.page = a.page GROUP BY 1, 2) SELECT cm.requested, cm.existing, x.model = y.model AS same, round(CASE WHEN greatest(coalesce(s.n, 0), coalesce(t.n, 0)) = 0 THEN 0 ELSE (greatest(coalesce(s.n, 0), coalesce(t.n, 0)) - common) / greatest(coalesce(s.n, 0), coalesce(t.n, 0)) END, 6) AS difference, x.model = y.model AND CASE WHEN greatest(coalesce(s.n, 0), coalesce(t.n, 0)) = 0 THEN 0 ELSE (greatest(coalesce(s.n, 0), coalesce(t.n, 0)) - common) / greatest(coalesce(s.n, 0), coalesce(t.n, 0)) END <= 0.8 AS reusable FROM cm JOIN mf x ON x.id = requested JOIN mf y ON y.id = existing LEFT JOIN sz s ON s.id = requested LEFT JOIN sz t ON t.id = existing")
def fork_opportunity(spark, sf_dir):
    """Pairs of neighbouring states: the same identity and few different pages."""
    m = T(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("model"))
    pages = T(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("id"), (C("l_partkey") % 20).alias("page"))
    pairs = m.select(C("id").alias("requested"), (C("id") - 1).alias("existing"))
    return statestore.fork_opportunities(pairs, m, pages, ["model"], 0.8)
