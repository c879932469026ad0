"""State graph: forks, walks, reachability, similarity; leases and policies as ordered CASEs.

A graph is a table (id, parent, released).  Walks up the parents double their
length a round: rounds grow with the logarithm of the longest chain, each is a
join of tables with a row per state, written to the shared folder.  The driver
sees a count a round and no depth is too deep.  A cycle of parents is an error
for ancestors and replays; its states are on no walk, and are reachable if one
of the cycle is not released.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, deal


def checked_parents(states: DataFrame) -> DataFrame:
    """A parent counts only if it exists."""
    rows = states.count()
    known = deal(states.select(F.col("id").alias("parent")), rows, "parent").distinct().withColumn("known", F.lit(True))
    joined = deal(states, rows, "parent").join(known, "parent", "left")
    return joined.select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), "released")


def _edges(states: DataFrame) -> DataFrame:
    return states.where("parent is not null").select("id", F.col("parent").alias("up")).distinct()


def _longest(n: int) -> int:
    """Rounds of doubling that cover any path without a cycle among n states."""
    return max(1, n).bit_length()


def jumps(edges: DataFrame, work: Scratch) -> Iterator[tuple[int, DataFrame]]:
    """(2**k, table of (id, up)) for k = 0, 1, ...: the ancestor so many steps up, while there is any."""
    now, n = work.store("jump0", edges), None
    for k in range(64):
        n = n or now.count()
        if k and now.isEmpty():
            return
        if k > _longest(n):
            raise ValueError("the parents form a cycle")
        yield 1 << k, now
        then = now.select(F.col("id").alias("up"), F.col("up").alias("far"))
        now = work.store(f"jump{k + 1}", now.join(then, "up").select("id", F.col("far").alias("up")))
        work.drop(f"jump{k}")


def ancestors(states: DataFrame) -> DataFrame:
    """(id, ancestor, depth) up the parent chain: as many rows as there are pairs."""
    work = Scratch(states.sparkSession, "ancestors")
    found = None
    for k, (length, jump) in enumerate(jumps(_edges(states), work)):
        if found is None:
            new = jump.select("id", F.col("up").alias("ancestor"), F.lit(1).cast("bigint").alias("depth"))
        else:  # what the ancestor this far up has found before
            far = found.select(F.col("id").alias("up"), "ancestor", "depth")
            new = jump.join(far, "up").select("id", "ancestor", (F.col("depth") + length).alias("depth"))
            own = jump.select("id", F.col("up").alias("ancestor"), F.lit(length).cast("bigint").alias("depth"))
            new = found.unionByName(new).unionByName(own)
        found = work.store(f"found{k}", new)
        work.drop(f"found{k - 1}")
    if found is None:
        return states.select("id", F.col("parent").alias("ancestor"), F.lit(0).cast("bigint").alias("depth")).limit(0)
    return found.groupBy("id", "ancestor").agg(F.min("depth").alias("depth"))


def first_children(states: DataFrame) -> DataFrame:
    """(root, id, step): from each root along the first child of each state."""
    work = Scratch(states.sparkSession, "walks")
    edges = _edges(states)
    first = edges.groupBy("up").agg(F.min("id").alias("id"))
    # top: the state that is reached going up while each is its parent's first child
    roots = states.where("parent is null").select("id").distinct()
    start = roots.withColumn("top", F.col("id")).withColumn("step", F.lit(0).cast("bigint")).withColumn("done", F.lit(True))
    climb = first.select("id", F.col("up").alias("top"), F.lit(1).cast("bigint").alias("step"), F.lit(False).alias("done"))
    now = work.store("0", start.unionByName(climb))
    rounds = _longest(now.count())
    for k in range(rounds):
        if now.where("not done").isEmpty():
            break
        then = now.select(F.col("id").alias("top"), F.col("top").alias("far"), F.col("step").alias("more"), F.col("done").alias("ends"))
        climbed = now.where("not done").join(then, "top").select(
            "id", F.col("far").alias("top"), (F.col("step") + F.col("more")).alias("step"), F.col("ends").alias("done"),
        )
        now = work.store(str(k + 1), now.where("done").unionByName(climbed))
        work.drop(str(k))
    return now.where("done").select(F.col("top").alias("root"), "id", "step")


def reachable(states: DataFrame) -> DataFrame:
    """(id) of states that are not released or descend from one that is not.

    Each round a state learns whether one of twice as many ancestors is live;
    those that know, or have no ancestors left, look no further.
    """
    work = Scratch(states.sparkSession, "reachable")
    kept = states.groupBy("id").agg(F.min("released").alias("released"), F.max("parent").alias("up"))
    now = work.store("0", kept.select("id", (~F.col("released")).alias("live"), F.when(F.col("released"), F.col("up")).alias("up")))
    for k in range(_longest(now.count())):
        if now.where("up is not null").isEmpty():
            break
        then = now.select(F.col("id").alias("up"), F.col("live").alias("above"), F.col("up").alias("far"))
        asked = now.where("up is not null").join(then, "up").select("id", F.col("above").alias("live"), F.when(~F.col("above"), F.col("far")).alias("up"))
        now = work.store(str(k + 1), now.where("up is null").unionByName(asked))
        work.drop(str(k))
    return now.where("live").select("id")


def collectable(states: DataFrame, pages: DataFrame, rows: int | None = None) -> DataFrame:
    """(page) of unreachable states only; pages as (id, page), rows about their number, as for delta."""
    rows = pages.count() if rows is None else rows
    live = reachable(states).withColumn("live", F.lit(True))
    held = deal(pages, rows, "id").join(states.select("id").distinct(), "id", "left_semi").join(live, "id", "left")
    return deal(held, rows, "page").groupBy("page").agg(F.max("live").alias("live")).where("live is null").select("page")


def replayed(states: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, first_session, deepest): states that some session's chain holds, each once.

    sessions as (id); deepest counts the steps below down to a session.
    """
    work = Scratch(states.sparkSession, "replay")
    start = sessions.select("id", F.col("id").alias("first_session"), F.lit(0).cast("bigint").alias("deepest")).distinct()
    now, k = work.store("0", start), 0
    best = (F.min("first_session").alias("first_session"), F.max("deepest").alias("deepest"))
    for length, jump in jumps(_edges(states), work):
        sent = now.join(jump, "id").select(F.col("up").alias("id"), "first_session", (F.col("deepest") + length).alias("deepest"))
        now = work.store(str(k + 1), now.unionByName(sent).groupBy("id").agg(*best))
        work.drop(str(k))
        k += 1
    return now


def similarity(states: DataFrame, pages: DataFrame, tolerance: float, rows: int | None = None) -> DataFrame:
    """(id, parent, difference, reusable) of each state and its parent by their page sets.

    rows is about the number of pages, as for delta.
    """
    rows = pages.count() if rows is None else rows
    pages = deal(pages, rows, "id")
    edges = deal(states.where("parent is not null").select("id", "parent"), rows, "id")
    size = pages.groupBy("id").agg(F.count("*").alias("n"))
    own = deal(edges.join(pages, "id"), rows, "parent", "page")
    old = deal(pages.select(F.col("id").alias("parent"), "page", F.lit(1).alias("hit")), rows, "parent", "page")
    common = deal(own.join(old, ["parent", "page"], "left"), rows, "id").groupBy("id", "parent").agg(F.count("hit").alias("common"))
    sized = deal(common.join(size, "id"), rows, "parent").join(size.select(F.col("id").alias("parent"), F.col("n").alias("m")), "parent")
    most = F.greatest("n", "m")
    gap = (most - F.col("common")) / most
    return sized.select("id", "parent", F.round(gap, 6).alias("difference"), (gap <= tolerance).alias("reusable"))


def delta(edges: DataFrame, pages: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, page, change) between a state and its parent: pages added, and pages removed; one aggregate tells the sides apart.

    edges as (id, parent), each once; pages as (id, page), each once.  rows is
    about the number of pages where the caller knows it; they are counted else.
    Tasks are dealt by it: a state has one parent, so both sides together have
    about twice as many rows.
    """
    rows = pages.count() if rows is None else rows
    pages = deal(pages, rows, "id")
    own = deal(edges, rows, "id").join(pages, "id").select("id", "page", F.lit(1).alias("side"))
    old = deal(edges, rows, "parent").join(pages.withColumnRenamed("id", "parent"), "parent").select("id", "page", F.lit(2).alias("side"))
    sides = deal(own.unionByName(old), 2 * rows, "id", "page").groupBy("id", "page").agg(F.sum("side").alias("side")).where("side != 3")
    return sides.select("id", "page", F.when(F.col("side") == 1, "added").otherwise("removed").alias("change"))


def lease_status(now: float, epoch: int, right: int) -> Column:
    """Principal before state before expiry before revocation before right."""
    return (
        F.when(F.col("principal") != "owner", "PrincipalMismatch").when(~F.col("same_state"), "StateMismatch")
        .when(F.lit(now) >= F.col("expires"), "Expired").when(F.lit(epoch) > F.col("epoch"), "Revoked")
        .when(F.col("rights").bitwiseAND(F.lit(right)) == 0, "MissingRight").otherwise("Active")
    )


def compression(protected: Column, calibrated: Column, is_key: Column) -> Column:
    return F.when(protected, "raw:protected").when(~calibrated, "raw:uncalibrated").when(is_key, "per_channel").otherwise("per_token")


def parse_codec(column: str) -> list[Column]:
    c = F.col(column)
    bits = F.regexp_extract(c, "_([0-9]+)bit", 1).cast("bigint")
    valid = c.rlike("^(turbo|fib)_[0-9]+bit(_lossy)?$") & bits.between(2, 16)
    return [bits.alias("bits"), c.startswith("turbo").alias("turbo"), c.endswith("_lossy").alias("lossy"), valid.alias("valid")]
