"""Size-aware heavy-light similarity join on word n-grams.

Documents are sets of distinct n-word shingles; two link when
100 * intersection >= 100 * threshold * union.  Equal sets fold into one class
first, so copies cost one set whatever their number.

Light sets (smaller than a boundary) enumerate subsets: a pair of sizes s and t
links exactly if it shares a subset of the overlap that s + t demands, so all
subsets of that size are hashed keys and sharing a key proves the link.  A key
then joins everything it holds to its least member: no pairs are formed.

Heavy sets use inverted lists.  Lists of single shingles would be as long as
the corpus is large, so a list's key is a block of shingles: with at most D
differences allowed, D + 1 hash-dealt blocks leave one block equal.  A set is
filed under its blocks, members of a list that a sketch does not tell apart hang
together in a candidate family, and within a family the exact overlaps are
counted by scanning the inverted
lists of the rarest shingles that a linked set has to share.  Families beyond
``family_block`` sets are scanned as pairs of blocks, so no task holds more
than two blocks; only the links of a spanning forest leave a task.  Before
that, each set is verified with the heads of its lists: sets that these links
join already need not meet again, so a large group of near copies costs its
heads and its stragglers, not all its pairs of blocks.

A block may be one common shingle, so lists also hold sets that have little
else in common, and through these families would grow with the corpus.  The
sketch of a set has the parities of its shingles' counts in buckets.  Each
difference of two sets flips one parity, so sketches that differ in more places
than a link allows rule the link out: no link is lost.  Only lists whose head
is told apart from a member are looked at again, pair by pair.

The boundary is where enumerating costs more keys than list keys and their
checks would.

Edge cases: null, empty and wordless texts have the empty set and link with
nothing; texts of fewer words than n are one shingle; repeated rows give a row
each; a null id is its own component; rows that repeat an id with another text
are told apart by their sets, and share the component of the id; ids are of
any type that sorts.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, runtime_filters, slices
from .components import components

N_WORDS = 3
THRESHOLD_PERCENT = 90
FAMILY_BLOCK = 2000
#: Cost of a list key against an enumerated one: lists have to be checked.
LIST_COST = 8
#: Members of a list that are told apart pair by pair; longer lists stay whole, which costs larger families but no link.
LIST_MEMBERS = 4000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int = N_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; A-Z count as lower case."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        total = mix(total * _A + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def need(total: int, percent: int) -> int:
    """Least overlap of two linked sets whose sizes add up to total."""
    return -(-percent * total // (100 + percent))


def fits(s: int, t: int, percent: int) -> bool:
    return 100 * min(s, t) >= percent * max(s, t)


def partners(s: int, percent: int) -> range:
    """Sizes that a set of size s may link with."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


@cache
def boundary(percent: int) -> int:
    """Least size for which enumerating subsets costs more than list keys and checks."""
    s = 1
    while True:
        subsets = sum(math.comb(s, need(s + t, percent)) for t in partners(s, percent) if need(s + t, percent) <= min(s, t))
        differ = max(s + t - 2 * need(s + t, percent) for t in partners(s, percent))
        if subsets > LIST_COST * 2 * (differ + 1):
            return s
        s += 1


@cache
def band(s: int, percent: int) -> tuple[int, int]:
    """Number and least size of the band of size s; a linked larger set is in the same band or the next."""
    at, low = 0, boundary(percent)
    while (high := max(low, 100 * low // percent)) < s:
        at, low = at + 1, high + 1
    return at, low


@cache
def blocks(low: int, percent: int) -> tuple[int, int]:
    """(blocks, spare) for pairs whose smaller set is in the band from low on.

    Blocks are the most differences + 1 + spare, so at least spare + 1 blocks are
    equal.  A set with at most spare empty blocks need not file itself under
    those: one of the equal blocks is another.
    """
    high = max(low, 100 * low // percent)
    most = high + 100 * high // percent  # both sizes together
    differ = most * (100 - percent) // (100 + percent)
    spare = 1 + math.ceil(2 * (differ + 1) * math.exp(-low / (differ + 1)))
    return 1 + differ + spare, spare


def list_keys(x: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a heavy set: its blocks for its own band and for the band below."""
    s = len(x)
    at, low = band(s, percent)
    bands = [(at, low)]
    if at:
        below = low - 1
        at, low = band(below, percent)
        if fits(below, s, percent):
            bands.append((at, low))
    out, where, what = [], mix(x), mix(x ^ _A)
    for at, low in bands:
        m, spare = blocks(low, percent)
        sums, block = np.zeros(m, np.uint64), (where % np.uint64(m)).astype(np.int64)
        np.add.at(sums, block, what)
        keys = mix(sums + mix(np.arange(m, dtype=np.uint64) * _A + np.uint64(at + 1)))
        filled = np.bincount(block, minlength=m) > 0
        out.append(keys[filled] if m - filled.sum() <= spare else keys)
    return np.concatenate(out)


def sketch(x: np.ndarray) -> bytes:
    """Size and bucket parities of a set; as many buckets as shingles at least, a power of two."""
    buckets = max(64, 1 << (len(x) - 1).bit_length())
    odd = np.bincount((mix(x ^ _C) % np.uint64(buckets)).astype(np.int64), minlength=buckets) & 1
    return np.uint32(len(x)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def unpacked(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and the parities as rows of 64-bit words; all folded to the fewest buckets among them."""
    sizes = np.array([int.from_bytes(k[:4], "little") for k in sketches])
    width = min(map(len, sketches)) // 8  # the 4 bytes of the size do not count
    rows = np.empty((len(sketches), width), np.uint64)
    for i, k in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(k, np.uint64, offset=4).reshape(-1, width), axis=0)
    return sizes, rows


def may_link(s, a: np.ndarray, t, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes s and t may link by their sizes and parities; false rules it out."""
    total = s + t
    most = total + 2 * (-percent * total // (100 + percent))  # differences of a linked pair
    return (100 * np.minimum(s, t) >= percent * np.maximum(s, t)) & (np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= most)


def told_apart(sketches: list[bytes | None], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link; a missing sketch may link with all."""
    if None in sketches:
        wild = sketches.index(None)
        return [(i, wild) for i in range(len(sketches)) if i != wild]
    sizes, rows = unpacked(sketches)
    rest, found = np.arange(len(sketches)), []
    while len(rest) > 1:
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            i = reached.pop()
            near = may_link(sizes[i], rows[i], sizes[rest], rows[rest], percent)
            new = rest[near].tolist()
            found += [(j, i) for j in new]
            reached += new
            rest = rest[~near]
    return found


def subset_keys(x: np.ndarray, percent: int) -> list[tuple[int, int, bool]]:
    """(key, size, same): the subsets that a pair with a light set would share.

    Keys hold the sum of both sizes; same: the partner has this size too.
    """
    s, edge, out = len(x), boundary(percent), []
    v = mix(x ^ _B)
    whole = v.sum(dtype=np.uint64)
    for t in partners(s, percent):
        c = need(s + t, percent)
        if min(s, t) >= edge or c > min(s, t):
            continue
        left_out = list(combinations(range(s), s - c))
        left_out = np.array(left_out, np.int64).reshape(len(left_out), s - c)
        keys = mix(whole - v[left_out].sum(1, dtype=np.uint64) + mix(np.array([s + t], np.uint64)))
        out += [(k, s, s == t) for k in keys.view(np.int64).tolist()]
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id, n, d1, d2, light, heavy, sketch): size, digest and keys of each document's set."""
    source = pick(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    light = pa.list_(pa.struct([("key", pa.int64()), ("size", pa.int32()), ("same", pa.bool_())]))

    def run(batches):
        for batch in slices(batches):
            rows = {"n": [], "d1": [], "d2": [], "light": [], "heavy": [], "sketch": []}
            for text in batch.column("text").to_pylist():
                x = shingle_set(text, n)
                s = len(x)
                d1, d2 = _digests(x)
                rows["n"].append(s)
                rows["d1"].append(d1)
                rows["d2"].append(d2)
                enumerate_ = s and 100 * s // percent >= 1 and -(-percent * s // 100) < boundary(percent)
                rows["light"].append([dict(zip(("key", "size", "same"), k, strict=True)) for k in subset_keys(x, percent)] if enumerate_ else None)
                rows["heavy"].append(list_keys(x, percent).view(np.int64) if s >= boundary(percent) else None)
                rows["sketch"].append(sketch(x) if s >= boundary(percent) else None)
            types = {"n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "light": light, "heavy": pa.list_(pa.int64()), "sketch": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(rows[k], t) for k, t in types.items())], ["id", *types]
            )

    schema = f"id {kind}, n bigint, d1 bigint, d2 bigint, light array<struct<key:bigint,size:int,same:boolean>>, heavy array<bigint>, sketch binary"
    return source.mapInArrow(run, schema)


def light_links(found: DataFrame) -> DataFrame:
    """(a, b): links proved by shared subsets, each member to the least of its key.

    Keys that only copies of one set hold prove nothing that its class does not.
    """
    keys = found.where("light is not null").select(F.col("id").alias("a"), "d1", F.explode("light").alias("k")).select("a", "d1", "k.*")
    held = keys.groupBy("key").agg(
        F.min("a").alias("b"), F.min("d1").alias("low"), F.max("d1").alias("high"),
        F.min("size").alias("least"), F.max("size").alias("most"), F.max("same").alias("same"),
    )
    proved = held.where("low != high and (least != most or same)").select("key", "b")
    return keys.select("key", "a").join(proved.hint("merge"), "key").where("a != b").select("a", "b").distinct()


def list_stars(found: DataFrame) -> DataFrame:
    """(key, a, b): the members of each inverted list, each with the first one that its task has; one shuffle.

    The lists lie in ranges of (key, member), so a list that many sets share
    spreads over as many tasks as it needs.  Stars, not chains: paths stay
    short.  The ends of a task's lists come with a null b and their key: a list
    may go on in the next task.
    """
    keys = found.where("heavy is not null").select(F.explode("heavy").alias("key"), F.col("id").alias("a"))
    dealt = keys.repartitionByRange("key", "a").sortWithinPartitions("key", "a")

    def run(batches):
        first = last = None  # (key, member): of the list at hand, and of the row before
        end = lambda row: pa.RecordBatch.from_arrays([*row, pa.nulls(1, row[1].type)], ["key", "a", "b"])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key, a = batch.column("key"), batch.column("a")
            if first is None:
                first = key.slice(0, 1), a.slice(0, 1)
                yield end(first)
            keys, members = pa.concat_arrays([first[0], key]), pa.concat_arrays([first[1], a])
            k = keys.to_numpy()
            # place of the first row of each row's list; row 0 stands for the list at hand
            begins = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(n + 1), 0))
            heads = members.take(pa.array(begins))
            out = pa.RecordBatch.from_arrays([keys, members, heads], ["key", "a", "b"])
            yield out.filter(pc.not_equal(members, heads))
            first = keys.take(pa.array(begins[-1:])), heads.slice(n)
            last = key.slice(n - 1), a.slice(n - 1)
        if last is not None:
            yield end(last)

    kind = found.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"key bigint, a {kind}, b {kind}")


def list_pairs(stars: DataFrame) -> DataFrame:
    """(a, b): the stars' members with their heads, and lists that go on in other tasks tied together."""
    ends = stars.where("b is null").select("key", "a")  # two rows a task
    tied = ends.join(ends.groupBy("key").agg(F.min("a").alias("b")).hint("merge"), "key").select("a", "b")
    return stars.where("b is not null").select("a", "b").unionByName(tied)


def sketches_of(found: DataFrame) -> DataFrame:
    """(id, sketch): of each id with a heavy set; null if its sets have several."""
    low, high = F.min("sketch"), F.max("sketch")
    return found.where("sketch is not null").groupBy("id").agg(F.when(low == high, low).alias("sketch"))


def candidates(stars: DataFrame, sketches: DataFrame, percent: int, work: Scratch, list_members: int = LIST_MEMBERS) -> DataFrame:
    """(a, b): pairs that tie all that may link; sets of one list that may not are left apart.

    A head and a member that may link are a pair.  If all members of a list may
    link with its head, that is all.  Of other lists of three sets and more the
    members are told apart among each other, up to list_members of them; longer
    lists stay whole.
    """
    kind = stars.schema["a"].dataType.simpleString()
    of = lambda end: sketches.select(F.col("id").alias(end), F.col("sketch").alias(f"sketch_{end}")).hint("merge")

    def judge(batches):
        for batch in slices(batches):
            a, b = (batch.column(f"sketch_{k}").to_pylist() for k in "ab")
            near = [bool(told_apart([x, y], percent)) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    edges = list_pairs(stars).where("a != b").distinct().join(of("a"), "a").join(of("b"), "b")
    edges = work.store("edges", edges.mapInArrow(judge, f"a {kind}, b {kind}, near boolean"))
    near = edges.where("near").select("a", "b")
    # lists with a member that the head is told apart from, or that go on in other tasks
    held = stars.where("b is not null").join(edges.hint("merge"), ["a", "b"]).select("key", "a", "b", "near")
    ends = stars.where("b is null").select("key", "a").distinct()
    rows = held.select("key", F.lit(1).alias("n"), F.col("near")).unionByName(ends.select("key", F.lit(1).alias("n"), F.lit(False).alias("near")))
    lists = rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("near").alias("near")).where("n > 1 and not near")
    lists = work.store("open-lists", lists.select("key", (F.col("n") > list_members).alias("long")))
    member = stars.select("key", "a").unionByName(stars.where("b is not null").select("key", F.col("b").alias("a")).distinct())
    long = stars.join(lists.where("long").hint("merge"), "key", "left_semi")
    dealt = member.join(lists.where("not long").hint("merge"), "key", "left_semi").distinct()
    dealt = dealt.join(of("a"), "a").select("key", "a", "sketch_a").repartition("key").sortWithinPartitions("key", "a")

    def split(batches):
        key, ids, own, id_type = None, [], [], None

        def pairs():
            found = told_apart(own, percent)
            a, b = ([ids[x[k]] for x in found] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type)], ["a", "b"])

        for batch in slices(batches):
            id_type = batch.schema.field("a").type
            for at, a, k in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "sketch_a")), strict=True):
                if at != key:
                    if len(own) > 1:
                        yield pairs()
                    key, ids, own = at, [], []
                ids.append(a)
                own.append(k)
        if len(own) > 1:
            yield pairs()

    apart = dealt.mapInArrow(split, f"a {kind}, b {kind}")
    return near.unionByName(apart).unionByName(list_pairs(long)).where("a != b").distinct()


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def scan_lists(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the link graph of some sets, by inverted lists.

    Shingles are ordered by their list's length.  Linked sets share one of the
    first size - need + 1 of each, so only those lists are scanned for
    candidates; overlaps are then counted over all lists of the set.
    """
    sizes = np.array([len(x) for x in sets])
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    members = owner[order]  # the inverted lists, one after another
    start = np.concatenate([[0], np.cumsum(count)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    forest, links = Forest(len(sets)), []
    for i in np.argsort(sizes, kind="stable").tolist():
        own = token[first[i] : first[i + 1]]
        least = -(-percent * sizes[i] // 100)  # overlap with the smallest partner
        rare = own[np.argsort(count[own], kind="stable")[: sizes[i] - least + 1]]
        rare = rare[count[rare] > 1]
        if not len(rare):
            continue
        near = np.unique(np.concatenate([members[start[t] : start[t + 1]] for t in rare]))
        root = forest.find(i)
        near = [j for j in near.tolist() if forest.find(j) != root]
        if not near:
            continue
        if len(near) <= 8:
            overlap = {j: len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in near}
        else:
            overlap = np.bincount(np.concatenate([members[start[t] : start[t + 1]] for t in own]), minlength=len(sets))
        for j in near:
            o = int(overlap[j])
            if 100 * o >= percent * (int(sizes[i]) + int(sizes[j]) - o) and forest.join(i, j):
                links.append((i, j))
    return links


def members(classes: DataFrame, families: DataFrame) -> DataFrame:
    """(id, d1, d2, component, n): the sets of each family of two sets at least, and how many it has."""
    member = families.join(classes.select(F.col("rep").alias("id"), "d1", "d2").hint("merge"), "id")
    size = member.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return member.join(size.hint("merge"), "component")


def verified_links(docs: DataFrame, edges: DataFrame, n: int, percent: int, work: Scratch) -> DataFrame:
    """(a, b) of edges whose texts link; docs as (id, text), of an id with several texts any may."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    ends = work.store("edge-ends", ends.groupBy("id").agg(F.count("*").alias("n")))
    # the comparison, always true, is for a Bloom filter, as in heavy_links
    texts = docs.join(ends.where("n > 0").drop("n").hint("merge"), "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).select("id", "text")
    with runtime_filters(docs.sparkSession):
        texts = work.store("edge-texts", texts)
    of = lambda end: texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}")).hint("merge")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            keep, last, x = [], None, None
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if x is None or a != last:
                    last, x = a, shingle_set(a, n)
                y = shingle_set(b, n)
                o = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(o) and 100 * o >= percent * (len(x) + len(y) - o))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def places(member: DataFrame, clusters: DataFrame | None, family_block: int) -> DataFrame:
    """(id, d1, d2, component, n, pairs): the tasks that have to see each set.

    A family of up to family_block sets is one task.  Of a larger one, clusters
    (id, cluster) say which sets are joined already: a cluster that is large
    itself has blocks of its own, all others share blocks.  Two blocks of one
    large cluster need not meet; a set goes to every other pair with its block.
    """
    small = member.where(F.col("n") <= family_block)
    one = F.array(F.struct(F.lit("").alias("i"), F.lit("").alias("j")))
    out = small.withColumn("pairs", one)
    if clusters is None:
        return out
    at = ["component", "cluster"]
    big = member.where(F.col("n") > family_block).join(clusters.hint("merge"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    size = big.groupBy(*at).agg(F.count("*").alias("m"))
    large = size.where(F.col("m") > family_block)
    # blocks of a family: (name, number) of each large cluster and of the rest, which has no name
    named = large.select("component", F.col("cluster").cast("string").alias("name"), "m")
    rest = size.where(F.col("m") <= family_block).groupBy("component").agg(F.sum("m").alias("m")).select("component", F.lit(None).cast("string").alias("name"), "m")
    groups = named.unionByName(rest).withColumn("blocks", F.ceil(F.col("m") / family_block).cast("int"))
    each = groups.select("component", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct("name", k.alias("k")))).alias("t"))
    directory = each.groupBy("component").agg(F.collect_list("t").alias("directory"))
    own = big.join(large.select(*at, F.lit(True).alias("own")).hint("merge"), at, "left")
    own = own.withColumn("name", F.when(F.col("own"), F.col("cluster").cast("string")))
    own = own.join(groups.select("component", F.col("name").alias("g_name"), "blocks").hint("merge"), (own["component"] == groups["component"]) & own["name"].eqNullSafe(F.col("g_name"))).drop(groups["component"])
    own = own.join(directory.hint("merge"), "component")
    label = lambda name, k: F.concat(F.coalesce(name, F.lit("-")), F.lit(":"), k.cast("string"))
    mine = label(F.col("name"), F.pmod(F.xxhash64("id", "d1"), F.col("blocks")))
    met = F.filter("directory", lambda t: t["name"].isNull() | F.col("name").isNull() | (t["name"] != F.col("name")))
    pairs = F.transform(met, lambda t: F.struct(F.least(F.col("mine"), label(t["name"], t["k"])).alias("i"), F.greatest(F.col("mine"), label(t["name"], t["k"])).alias("j")))
    return out.unionByName(own.withColumn("mine", mine).withColumn("pairs", pairs).select(*out.columns))


def _digests(x: np.ndarray) -> list[int]:
    """128 bits that stand for a set."""
    return [int(mix(x ^ c).sum(dtype=np.uint64).astype(np.int64)) for c in (_A, _C)]


def heavy_links(docs: DataFrame, place: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each family; docs as (id, text).

    Texts travel, not their sets: a set's hashes take more room and do not compress.
    """
    # the comparison, always true, tells Spark that a Bloom filter of these few ids pays on the texts
    texts = docs.join(place.where("n > 1").drop("n").hint("merge"), "id")
    filed = texts.select("component", F.explode("pairs").alias("p"), "id", "d1", "d2", "text")
    filed = filed.select("component", "p.i", "p.j", "id", "d1", "d2", "text").repartition("component", "i", "j")
    filed = filed.sortWithinPartitions("component", "i", "j", "id", "d1", "d2")
    kind = filed.schema["id"].dataType.simpleString()

    def scan(batches):
        key, ids, own, id_type = None, [], [], None
        last = None

        def links():
            found = scan_lists(own, percent)
            a, b = ([ids[x[k]] for x in found] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type)], ["a", "b"])

        for batch in slices(batches):
            id_type = batch.schema.field("id").type
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "id", "d1", "d2", "text")]
            for *at, name, d1, d2, text in zip(*columns, strict=True):
                if at != key:
                    if len(own) > 1:
                        yield links()
                    key, ids, own, last = at, [], [], None
                if (name, d1, d2) == last:  # the row repeats
                    continue
                x = shingle_set(text, n)
                if _digests(x) == [d1, d2]:  # another text may share the id
                    ids.append(name)
                    own.append(x)
                    last = (name, d1, d2)
        if len(own) > 1:
            yield links()

    return filed.mapInArrow(scan, f"a {kind}, b {kind}")


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = N_WORDS,
    percent: int = THRESHOLD_PERCENT,
    family_block: int = FAMILY_BLOCK,
) -> DataFrame:
    """(id, n_shingles, component_id): the least id that links reach from each document."""
    work = Scratch(docs.sparkSession, "ngrams")
    found = work.store("signatures", signatures(docs, id_col, text_col, n, percent))
    named = found.where("n > 0 and id is not null")
    classes = work.store("classes", named.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")))
    stars = work.store("stars", list_stars(named))
    light = work.store("light", light_links(named))
    sizes = work.store("sizes", found.select("id", "n", "d1", "d2"))
    sketches = work.store("sketches", sketches_of(named))
    work.drop("signatures")
    pairs = work.store("pairs", candidates(stars, sketches, percent, work))
    work.drop("stars", "sketches", "edges", "open-lists")
    families = work.store("families", components(pairs))
    member = work.store("members", members(classes, families))
    work.drop("families")
    source = pick(docs, id=id_col, text=text_col)
    big, clusters, verified = member.where(F.col("n") > family_block).select(F.col("id").alias("a")).distinct(), None, None
    if not big.isEmpty():
        # what the heads of lists prove spares large families most of their pairs
        edges = pairs.join(big.hint("merge"), "a")
        verified = work.store("verified", verified_links(source, edges, n, percent, work))
        clusters = work.store("clusters", components(verified).select("id", F.col("component").alias("cluster")))
    work.drop("pairs", "edge-ends", "edge-texts")
    place = work.store("places", places(member, clusters, family_block))
    work.drop("members", "clusters")
    # copies of a class hang in its family; one of them stands for all
    with runtime_filters(docs.sparkSession):
        heavy = work.store("heavy", heavy_links(source, place, n, percent))
    # copies are joined through their class, however they were linked
    copies = sizes.where("n > 0 and id is not null").join(classes.hint("merge"), ["n", "d1", "d2"]).where("id != rep")
    linked = heavy.unionByName(light) if verified is None else heavy.unionByName(light).unionByName(verified)
    linked = linked.unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    reached = components(linked)
    work.drop("classes", "places", "heavy", "light", "verified")
    return sizes.select("id", "n").join(reached.hint("merge"), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_WORDS, percent: int = THRESHOLD_PERCENT
) -> DataFrame:
    """One document of each component, the one with the least id, with all columns.

    Documents without words or id stay; of rows that repeat the kept id all stay.
    """
    found = similar_documents(docs, id_col, text_col, n, percent)
    gone = found.where(F.col(f"`{id_col}`") != F.col("component_id")).select(F.col(f"`{id_col}`").alias("__id"))
    gone = Scratch(docs.sparkSession, "gone").store("ids", gone.distinct())
    return docs.join(gone.hint("merge"), docs[f"`{id_col}`"] == F.col("__id"), "left_anti")
