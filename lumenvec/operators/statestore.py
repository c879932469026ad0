"""Transitions of the state store: tables in, the next version of a table and a verdict per request out.

States are (id, parent, released), leases (lease_id, state_id, principal,
namespace, rights, issued, expires, epoch).  A request that breaks a rule
changes nothing and says why.  Requests of one call are judged against the
tables as they were; of several for one new id the least counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import deal

# Bits of the rights.
INSPECT, MATERIALIZE, FORK, APPEND, RELEASE = 1, 2, 4, 8, 16
LEASE_PREFIX, STATE_PREFIX = "lease-v1:", "hybrid-state-v1:"
#: What an attempt under a lease that is not active is refused with.
REFUSALS = {
    "PrincipalMismatch": "lease principal mismatch", "StateMismatch": "lease state mismatch", "Expired": "lease expired",
    "Revoked": "lease revoked", "MissingRight": "lease missing required right",
}


def _known(states: DataFrame, name: str = "known") -> DataFrame:
    return states.groupBy("id").agg(F.max("released").alias("dead")).withColumn(name, F.lit(True))


def _once(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Whether a request is the first of those for its key."""
    first = requests.groupBy(key).agg(F.min(order).alias("first"))
    return requests.join(first, key).withColumn("again", F.col(order) != F.col("first")).drop("first")


def commit_roots(states: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, verdict) of requests (id): ok or exists."""
    asked = requests.select("id").distinct().join(_known(states), "id", "left")
    return asked.select("id", F.when(F.col("known"), "exists").otherwise("ok").alias("verdict"))


def fork(states: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, parent, verdict) of requests (id, parent): ok, parent_missing, parent_released or exists."""
    asked = _once(requests.select("id", "parent").distinct(), "id", "parent")
    asked = asked.join(_known(states).select(F.col("id").alias("parent"), "dead", "known"), "parent", "left")
    asked = asked.join(_known(states, "taken").select("id", "taken"), "id", "left")
    verdict = F.when(F.col("known").isNull(), "parent_missing").when(F.col("dead"), "parent_released").when(F.col("taken") | F.col("again"), "exists").otherwise("ok")
    return asked.select("id", "parent", verdict.alias("verdict"))


def with_forks(states: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The states and those that may join them."""
    new = verdicts.where("verdict = 'ok'").select("id", "parent", F.lit(False).alias("released"))
    return states.select("id", "parent", "released").unionByName(new)


def branch(manifests: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, parent, parent_lineage): the parent appended to its lineage; manifests as (id, parent_lineage)."""
    up = manifests.select(F.col("id").alias("parent"), "parent_lineage")
    return requests.select("id", "parent").join(up, "parent").select("id", "parent", F.concat("parent_lineage", F.array("parent")).alias("parent_lineage"))


def register_leases(states: DataFrame, leases: DataFrame, requests: DataFrame) -> DataFrame:
    """(lease_id, state_id, verdict): ok, registered, state_missing or state_released."""
    asked = _once(requests.select("lease_id", "state_id").distinct(), "lease_id", "state_id")
    asked = asked.join(leases.select("lease_id").distinct().withColumn("held", F.lit(True)), "lease_id", "left")
    asked = asked.join(_known(states).withColumnRenamed("id", "state_id"), "state_id", "left")
    verdict = F.when(F.col("held") | F.col("again"), "registered").when(F.col("known").isNull(), "state_missing").when(F.col("dead"), "state_released").otherwise("ok")
    return asked.select("lease_id", "state_id", verdict.alias("verdict"))


def revoke_leases(leases: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leases that stay, and (lease_id, verdict) of requests (lease_id): ok or missing."""
    asked = requests.select("lease_id").distinct()
    held = leases.select("lease_id").distinct().withColumn("held", F.lit(True))
    verdict = asked.join(held, "lease_id", "left").select("lease_id", F.when(F.col("held"), "ok").otherwise("missing").alias("verdict"))
    return leases.join(asked, "lease_id", "left_anti"), verdict


def release(states: DataFrame, requests: DataFrame) -> DataFrame:
    """The states with those of requests (id) released; live leases do not hinder it."""
    gone = requests.select("id").distinct().withColumn("now", F.lit(True))
    return states.join(gone, "id", "left").select("id", "parent", (F.col("released") | F.coalesce("now", F.lit(False))).alias("released"))


def leased_states(leases: DataFrame) -> DataFrame:
    """(id) of states that a registered lease keeps from collection."""
    return leases.select(F.col("state_id").alias("id")).distinct()


def rooted(states: DataFrame, leases: DataFrame) -> DataFrame:
    """The states with released ones that a lease holds counted as live: the roots of collection."""
    held = leased_states(leases).withColumn("held", F.lit(True))
    return states.join(held, "id", "left").select("id", "parent", (F.col("released") & F.col("held").isNull()).alias("released"))


def refusal(status: Column) -> Column:
    """The message for a status; null if it is active."""
    out = F.when(status == "Active", F.lit(None).cast("string"))
    for name, text in REFUSALS.items():
        out = out.when(status == name, text)
    return out


def authorize(rows: DataFrame, status: Column) -> DataFrame:
    """The rows, if all are active; else the read fails with the refusal."""
    fine = F.when(refusal(status).isNull(), F.lit(True)).otherwise(F.raise_error(refusal(status)))
    return rows.where(fine)


def lease_id(now: int) -> Column:
    """Id of a lease request issued now: it binds everything that is issued."""
    fields = ("principal", "namespace", "run_id", "node_id", "attempt", "state_id", "rights", "ttl", "epoch", "nonce")
    bound = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fields], F.lit(now).cast("string"))
    return F.concat(F.lit(LEASE_PREFIX), F.sha2(bound, 256))


def issue_leases(requests: DataFrame, now: int) -> DataFrame:
    """Leases of requests (principal, namespace, run_id, node_id, attempt, state_id, rights, ttl, epoch, nonce); a null ttl never expires."""
    return requests.select(
        lease_id(now).alias("lease_id"), "state_id", "principal", "namespace", "rights",
        F.lit(now).cast("bigint").alias("issued"), (F.lit(now) + F.col("ttl")).cast("bigint").alias("expires"), "epoch",
    )


def snapshot(states: DataFrame, leases: DataFrame, bucket: int = 1000) -> DataFrame:
    """(bucket, states, leases, digest): the sorted ids of each range of ids, digested; ids are numbers."""
    at = lambda c: F.floor(F.col(c) / bucket).alias("bucket")
    ids = states.select("id").distinct().groupBy(at("id")).agg(F.count("*").alias("states"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"))
    held = leases.groupBy(at("state_id")).agg(F.count("*").alias("leases"))
    return ids.join(held, "bucket", "left").select("bucket", "states", F.coalesce("leases", F.lit(0)).alias("leases"), F.sha2("ids", 256).alias("digest"))


def counts(states: DataFrame, leases: DataFrame) -> DataFrame:
    """One row: (states, released, leases)."""
    s = states.agg(F.count("*").alias("states"), F.count_if("released").alias("released"))
    return s.crossJoin(leases.agg(F.count("*").alias("leases")))  # a row each


def fork_opportunities(pairs: DataFrame, manifests: DataFrame, pages: DataFrame, identity: list[str], tolerance: float) -> DataFrame:
    """(requested, existing, same, difference, reusable) of pairs of manifests.

    manifests as (id, identity columns), pages as (id, page).  Reusable: all
    identity columns equal and (larger - common) / larger <= tolerance; two
    empty page sets differ by 0; a tolerance outside 0 to 1 reuses nothing.
    """
    side = lambda new: manifests.select(F.col("id").alias(new), F.struct(*identity).alias(f"{new}_is"))
    met = pairs.select("requested", "existing").distinct().join(side("requested"), "requested").join(side("existing"), "existing")
    rows = pages.count()
    pages = deal(pages.select("id", "page"), rows, "id").distinct()
    size = pages.groupBy("id").agg(F.count("*").alias("n"))
    of = lambda new, n: size.select(F.col("id").alias(new), F.col("n").alias(n))
    met = met.join(of("requested", "a"), "requested", "left").join(of("existing", "b"), "existing", "left")
    own = deal(met.select("requested", "existing"), rows, "requested").join(pages.withColumnRenamed("id", "requested"), "requested")
    common = deal(own, rows, "existing", "page").join(deal(pages.withColumnRenamed("id", "existing"), rows, "existing", "page"), ["existing", "page"]).groupBy("requested", "existing").agg(F.count("*").alias("common"))
    met = met.join(common, ["requested", "existing"], "left").na.fill(0, ["a", "b", "common"])
    most = F.greatest("a", "b")
    gap = F.coalesce(F.try_divide(most - F.col("common"), most), F.lit(0.0))
    same = F.col("requested_is") == F.col("existing_is")
    return met.select("requested", "existing", same.alias("same"), F.round(gap, 6).alias("difference"), (same & (gap <= tolerance) & F.lit(0 <= tolerance <= 1)).alias("reusable"))


# ---------------------------------------------------------------- sessions and workflows


def checkpoints(steps: DataFrame) -> DataFrame:
    """(workflow_id, step_states) of (workflow_id, step, state_id); a workflow's steps are bounded."""
    return steps.groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "state_id"))), lambda s: s["state_id"]).alias("step_states"))


def resume(snapshots: DataFrame) -> DataFrame:
    """(workflow_id, step, state_id) in the order of the checkpoint."""
    return snapshots.select("workflow_id", F.posexplode("step_states").alias("step", "state_id"))


def tool_sessions(calls: DataFrame) -> DataFrame:
    """(call, before_hash, after_hash, complete) of (call, before, after): complete once an after state is recorded."""
    return calls.select("call", F.sha2("before", 256).alias("before_hash"), F.sha2("after", 256).alias("after_hash"), F.col("after").isNotNull().alias("complete"))


# ---------------------------------------------------------------- deliveries


def admitted(queued: DataFrame, delivered: DataFrame) -> DataFrame:
    """(sequence, payload) that may be received: each once, in order, and none that is acknowledged."""
    once = queued.groupBy("sequence").agg(F.min("payload").alias("payload"))
    return once.join(delivered.select("sequence").distinct(), "sequence", "left_anti")


def acknowledge(delivered: DataFrame, sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All acknowledged sequences, and (sequence, first): whether each was new."""
    known = delivered.select("sequence").distinct().withColumn("known", F.lit(True))
    asked = sequences.select("sequence").distinct().join(known, "sequence", "left")
    every = delivered.select("sequence").unionByName(sequences.select("sequence")).distinct()
    return every, asked.select("sequence", F.col("known").isNull().alias("first"))


def standby(snapshots: DataFrame, states: DataFrame) -> DataFrame:
    """(scope, sequence, state_id) of each scope's latest snapshot, if its digest holds and its state exists.

    snapshots as (scope, sequence, state_id, digest).
    """
    last = snapshots.groupBy("scope").agg(F.max_by(F.struct("sequence", "state_id", "digest"), "sequence").alias("s")).select("scope", "s.*")
    right = last.where(F.sha2(F.col("state_id").cast("string"), 256) == F.col("digest"))
    return right.join(states.select(F.col("id").alias("state_id")).distinct(), "state_id", "left_semi").select("scope", "sequence", "state_id")


def due(events: DataFrame, interval: int) -> DataFrame:
    """(scope, event, taken): whether a snapshot is due at an event, one per interval of the scope's own clock.

    events as (scope, at, event): the first event of each started interval since the scope's first one.
    """
    w = Window.partitionBy("scope")
    slot = F.floor((F.col("at") - F.min("at").over(w)) / interval)
    placed = events.withColumn("slot", slot)
    return placed.withColumn("taken", F.row_number().over(Window.partitionBy("scope", "slot").orderBy("at", "event")) == 1).select("scope", "event", "taken")
