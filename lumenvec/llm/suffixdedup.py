"""Exact substring dedup with a logarithmic family of suffix arrays.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else in the corpus.  Sorting every suffix of a corpus in one place cannot
scale, so the suffixes are dealt first: each window of ``report_length`` bytes
belongs to its minimiser, the least hash of the ``gram``-byte grams inside it.
Equal windows have equal minimisers at equal places, so neighbouring windows
with one minimiser form a stretch, and equal windows meet under its hash.

1. Every text yields its stretches: minimiser, digest of the content, place.
   Content is what the stretch's windows and the ``length``-byte strings that
   begin with them cover.  Content that a text repeats itself counts as found.
2. Minimisers that occur once cannot repeat and go.  Stretches of equal content
   (128 bits: minimiser and digest) are repeated as a whole and fold into one.
3. Only the contents that share a minimiser with a different content move as
   bytes, one copy each, to the index of that minimiser.

The index is a family of suffix arrays.  Each arriving batch gets a suffix
array (prefix tripling on its bytes; the contents of one minimiser are one
batch, up to KEY_BYTES), is merge-scanned against the existing
levels for matches of the whole length, marking both sides, and becomes a
level; a level that is no more than twice the next one merges with it, so
levels grow geometrically.  Matches are matches of bytes, not of hashes.  A
family ends with its minimiser, so a task holds a bounded number of bytes; a
minimiser with more than ``hot_contents`` different contents does not go to one
task: its windows are counted as rows by two 64-bit fingerprints beside the
minimiser, folded on the map side.

Edge cases: null and empty texts lose nothing and have the digest of the empty
string; rows are told apart by id and text, so repeated rows are removed as
copies of each other and a null id is an id like others; periodic text folds
within its document; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, slices

LENGTH = 400
#: Shorter repeats are not removed, only counted (``n_repeated``).
REPORT_LENGTH = 216
GRAM = 32
HOT_CONTENTS = 2_000
#: Bytes of several minimisers that get one suffix array, about; positions and ranks then fit in 16 bits.
BATCH_BYTES = 60_000
#: Bytes of one minimiser that get one suffix array, about; positions and ranks then fit in 21 bits.
KEY_BYTES = 1_600_000
_MIX = np.uint64(0x94D049BB133111EB)

class Rolling:
    """Hashes of all substrings of one length: polynomials modulo 2**64 over random byte values."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            out = []
            for base in (self.base, pow(self.base, -1, 1 << 64)):
                p = np.full(n, base % (1 << 64), np.uint64)
                p[0] = 1
                out.append(np.cumprod(p, dtype=np.uint64))
            self.powers, self.inverse = out

    def hashes(self, raw: np.ndarray, length: int) -> np.ndarray:
        """One hash per starting place of a substring of that length."""
        n = len(raw)
        if n < length:
            return np.empty(0, np.uint64)
        self.grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[:n], dtype=np.uint64, out=sums[1:])
        h = (sums[length:] - sums[: n + 1 - length]) * self.inverse[: n + 1 - length]
        h ^= h >> np.uint64(31)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


GRAMS, WINDOWS = Rolling(1), (Rolling(2), Rolling(3))


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each w neighbours, in time linear in len(x)."""
    f = np.minimum if least else np.maximum
    n = len(x)
    pad = np.full(-n % w, np.uint64(2**64 - 1) if least else np.uint64(0))
    b = np.concatenate([x, pad]).reshape(-1, w)
    right = f.accumulate(b, axis=1).ravel()
    left = f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(left[: n - w + 1], right[w - 1 : n])


def stretches(raw: bytes, length: int = REPORT_LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first start, last start) of the runs of windows with one minimiser."""
    g = GRAMS.hashes(np.frombuffer(raw, np.uint8), gram)
    w = length - gram + 1
    if len(g) < w:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = _sliding(g, w, True)  # of each window
    # a gram is some window's least one if the greatest least of the windows over it is its own
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, False) == g)
    start = np.arange(len(least))
    at = np.searchsorted(chosen, start)
    while (wrong := np.flatnonzero(g[chosen[at]] != least)).size:
        at[wrong] += 1
    place = chosen[at]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return least[first], first, np.concatenate([first[1:] - 1, [len(least) - 1]])


def _ranks(key: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks from 1 of keys of 64 - bits bits, by one sort of (key, position)."""
    n = len(key)
    packed = np.sort(key << np.uint64(bits) | np.arange(n, dtype=np.uint64))
    place = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    packed >>= np.uint64(bits)
    out = np.empty(n, np.uint64)
    out[place] = np.concatenate([[1], np.cumsum(packed[1:] != packed[:-1]) + 1]).astype(np.uint64)
    return out


class SuffixRanks:
    """Ranks of the suffixes of a text by their first bytes, by prefix tripling, or doubling where ranks need over 16 bits.

    After ``deepen`` to d, suffixes compare by their first d bytes; what reaches
    beyond the text compares as if it were less than any byte.
    """

    def __init__(self, text: np.ndarray):
        if not 0 < len(text) < 1 << 21:
            raise ValueError("a batch has too many bytes")
        self.bits = 16 if len(text) < 1 << 16 else 21
        first = (64 - self.bits) // 8  # bytes that fit beside a position
        padded = np.concatenate([text, np.zeros(first, np.uint8)]).astype(np.uint64)
        key = np.zeros(len(text), np.uint64)
        for k in range(first):
            key = key << np.uint64(8) | padded[k : k + len(text)]
        self.depth, self.rank = first, _ranks(key, self.bits)

    def _later(self, step: int) -> np.ndarray:
        """The rank ``step`` on, 0 beyond the text."""
        out = np.zeros(len(self.rank), np.uint64)
        out[: max(0, len(out) - step)] = self.rank[step:]
        return out

    def deepen(self, depth: int) -> None:
        while self.depth < depth:
            more = min((64 // self.bits - 1) * self.depth, depth)
            key = self.rank << np.uint64(self.bits) | self._later(min(self.depth, more - self.depth))
            if more > 2 * self.depth:  # three ranks: those in between overlap where less is asked for
                key = key << np.uint64(self.bits) | self._later(more - self.depth)
            self.rank, self.depth = _ranks(key, self.bits), more


def _less(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of ``depth`` bytes from i in a and from j in b: whether the first is less, and whether they are equal."""
    less, same = np.empty(len(i), bool), np.empty(len(i), bool)
    span = np.arange(depth)
    for at in range(0, len(i), 8192):
        part = slice(at, at + 8192)
        x, y = a[i[part, None] + span], b[j[part, None] + span]
        differ = x != y
        first = differ.argmax(1)
        row = np.arange(len(first))
        less[part] = x[row, first] < y[row, first]
        same[part] = ~differ[row, first]
    return less, same


class Level:
    """A suffix array over a text: window starts in the order of their first ``depth`` bytes.

    number tells the windows of a family apart; mark says which occur elsewhere too.
    """

    def __init__(self, text: np.ndarray, order: np.ndarray, number: np.ndarray, mark: np.ndarray):
        self.text, self.order, self.number, self.mark = text, order, number, mark

    def find(self, other: Level, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per suffix of the other: how many of this level are less, and whether the next one is equal."""
        lo, hi = np.zeros(len(other.order), np.int64), np.full(len(other.order), len(self.order))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less, _ = _less(self.text, self.order[mid], other.text, other.order[open_], depth)
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        equal = np.zeros(len(lo), bool)
        inside = np.flatnonzero(lo < len(self.order))
        equal[inside] = _less(self.text, self.order[lo[inside]], other.text, other.order[inside], depth)[1]
        return lo, equal


class SuffixFamily:
    """Levels of suffix arrays with marks for the windows that occur elsewhere too."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.levels: list[Level] = []

    def add(self, text: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> None:
        """Another batch: windows that begin at ``starts``, ranked by their first ``depth`` bytes."""
        if not len(starts):
            return
        by_rank = np.argsort(rank[starts], kind="stable")
        order = starts[by_rank]
        mark = np.zeros(len(order), bool)
        same = rank[order[1:]] == rank[order[:-1]]
        mark[1:] |= same
        mark[:-1] |= same
        own = Level(text, order, by_rank + self.size, mark)
        self.size += len(order)
        for level in self.levels:
            at, hit = level.find(own, self.depth)
            own.mark |= hit
            level.mark[at[hit]] = True  # further equal ones in a level are marked already
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2].order) < 2 * len(self.levels[-1].order):
            new, old = self.levels.pop(), self.levels.pop()
            at, _ = old.find(new, self.depth)
            merged = np.argsort(np.concatenate([np.arange(len(old.order)) * 2 + 1, at * 2]), kind="stable")
            both = [np.concatenate(x)[merged] for x in ((old.order, new.order + len(old.text)), (old.number, new.number), (old.mark, new.mark))]
            self.levels.append(Level(np.concatenate([old.text, new.text]), *both))

    def marks(self) -> np.ndarray:
        out = np.zeros(self.size, bool)
        for level in self.levels:
            out[level.number] = level.mark
        return out


def _row_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, r1, r2): 128 bits that tell rows apart by id and text."""
    return pick(docs, id=id_col, text=text_col).select(
        "id", "text", F.xxhash64(F.lit(3), "id", F.col("id").isNull(), "text").alias("r1"),
        F.xxhash64(F.lit(5), "id", F.col("id").isNull(), "text").alias("r2"),
    )


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]


_STRETCH = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int32())])


def text_stretches(raw: bytes, length: int, report_length: int, gram: int) -> list[np.ndarray]:
    """[minimiser, content digest, first start, last start, n] of a text's stretches.

    n is 1, or 2 for the first of equal ones within the text; rows of n = 0 are
    ranges of starts that the others of equal ones cover.
    """
    key, lo, hi = stretches(raw, report_length, gram)
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)), np.uint64, len(key))
    n = np.ones(len(key), np.int32)
    if len(key) > 1:
        by = np.lexsort((lo, content, key))
        again = (key[by][1:] == key[by][:-1]) & (content[by][1:] == content[by][:-1])
        if again.any():
            repeats = np.concatenate([[False], again])
            n[by[np.flatnonzero(again)]] = 2
            gone = np.sort(by[repeats])
            cut = np.flatnonzero(lo[gone][1:] > hi[gone][:-1] + 1) + 1
            first, last = lo[gone][np.concatenate([[0], cut])], hi[gone][np.concatenate([cut, [len(gone)]]) - 1]
            n[gone] = -1
            keep, zero = n > 0, np.zeros(len(first), np.uint64)
            return [np.concatenate(x) for x in ((key[keep], zero), (content[keep], zero), (lo[keep], first), (hi[keep], last), (n[keep], np.zeros(len(first), np.int32)))]
    return [key, content, lo, hi, n]


def find_stretches(rows: DataFrame, length: int, report_length: int, gram: int) -> DataFrame:
    """(key, content, r1, r2, lo, hi, n) of every stretch of each row; see text_stretches."""

    def run(batches):
        for batch in slices(batches):
            found = [text_stretches(raw, length, report_length, gram) for raw in _bytes(batch)]
            row = np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found])
            kept = batch.select(["r1", "r2"]).take(pa.array(row))
            key, content, lo, hi, n = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [key.view(np.int64), content.view(np.int64), kept.column("r1"), kept.column("r2"), lo.astype(np.int32), hi.astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_STRETCH)

    return rows.select("text", "r1", "r2").mapInArrow(run, "key bigint, content bigint, r1 bigint, r2 bigint, lo int, hi int, n int")


_CONTENT = pa.schema([("key", pa.int64()), ("hot", pa.bool_()), ("single", pa.bool_()), ("r1", pa.int64()), ("r2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("raw", pa.binary())])


def cut_contents(rows: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """(key, hot, single, r1, r2, lo, hi, raw): the bytes of contents, from the rows that hold them."""
    place = F.struct("key", "hot", "single", "lo", "hi")
    by_row = contents.groupBy("r1", "r2").agg(F.collect_set(place).alias("places"))
    joined = rows.select("text", "r1", "r2").join(by_row.hint("merge"), ["r1", "r2"])

    def run(batches):
        for batch in slices(batches):
            places = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            flat, raws = places.flatten(), _bytes(batch)
            own = {k: flat.field(k) for k in ("key", "hot", "single", "lo", "hi")}
            cuts = zip(row.tolist(), own["lo"].to_pylist(), own["hi"].to_pylist(), strict=True)
            own["raw"] = pa.array([raws[i][a : b + length] for i, a, b in cuts], pa.binary())
            own |= {c: batch.column(c).take(pa.array(row)) for c in ("r1", "r2")}
            out = pa.RecordBatch.from_arrays([own[c] for c in _CONTENT.names], schema=_CONTENT)
            yield from slices([out])

    return joined.mapInArrow(run, "key bigint, hot boolean, single boolean, r1 bigint, r2 bigint, lo int, hi int, raw binary")


def _batches(keys: np.ndarray, sizes: np.ndarray):
    """(first, end) of runs of rows of about BATCH_BYTES."""
    first, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > BATCH_BYTES:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def _whole_keys(batches):
    """(keys, bytes, r1, r2, lo, hi, single) of rows ordered by key: runs of whole keys of about BATCH_BYTES.

    A key with more bytes is a run of its own, and beyond KEY_BYTES several: one
    suffix array of a key costs a fraction of merging many.
    """

    def rows(pieces):
        table = pa.Table.from_batches([batch.slice(a, b - a) for batch, a, b in pieces]).combine_chunks()
        keys, *rest = (table.column(c).to_numpy() for c in ("key", "r1", "r2", "lo", "hi", "single"))
        return keys, table.column("raw").to_pylist(), *rest

    whole, now, n_whole, n_now, key = [], [], 0, 0, None  # keys that ended, and the one that may go on
    for batch in slices(batches):
        keys = batch.column("key").to_numpy()
        sizes = pc.binary_length(batch.column("raw")).to_numpy()
        total = np.concatenate([[0], np.cumsum(sizes)])
        part = total[:-1] // (KEY_BYTES // 8)  # pieces of a key stay below KEY_BYTES too
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
            if keys[a] != key:
                if whole and n_whole + n_now > BATCH_BYTES:
                    yield rows(whole)
                    whole, n_whole = [], 0
                whole, n_whole = whole + now, n_whole + n_now
                now, n_now, key = [], 0, keys[a]
            elif n_now > KEY_BYTES:
                if whole:
                    yield rows(whole)
                    whole, n_whole = [], 0
                yield rows(now)
                now, n_now = [], 0
            now.append((batch, a, b))
            n_now += int(total[b] - total[a])
    for pieces in (whole, now):
        if pieces:
            yield rows(pieces)


class _Shard:
    """The contents at hand, in families for both lengths, until their minimiser ends."""

    def __init__(self, depths: tuple[int, int]):
        self.depths = depths  # the shorter first
        self.families = [SuffixFamily(d) for d in depths]
        self.held: list[list] = [[], []]  # per family: (r1, r2, start, single) of its windows

    def add(self, raws: list[bytes], r1: np.ndarray, r2: np.ndarray, lo: np.ndarray, hi: np.ndarray, single: np.ndarray) -> None:
        text = np.frombuffer(b"".join(raws), np.uint8)
        size = np.array([len(x) for x in raws])
        begin = np.cumsum(size) - size
        ranks = SuffixRanks(text)
        for k, depth in enumerate(self.depths):
            ranks.deepen(depth)
            n = np.maximum(0, np.minimum(hi - lo + 1, size - depth + 1))
            who = np.repeat(np.arange(len(raws)), n)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            self.families[k].add(text, begin[who] + nth, ranks.rank)
            self.held[k].append((r1[who], r2[who], lo[who] + nth, single[who]))

    def ranges(self):
        """Marked runs of starts of the contents that stand for one place: rows of (r1, r2, lo, hi, deep)."""
        for k, family in enumerate(self.families):
            if not family.size:
                continue
            r1, r2, start, single = (np.concatenate(x) for x in zip(*self.held[k], strict=True))
            at = np.flatnonzero(family.marks() & single)
            if not len(at):
                continue
            jump = (np.diff(at) != 1) | (np.diff(start[at]) != 1) | (np.diff(r1[at]) != 0) | (np.diff(r2[at]) != 0)
            cut = np.flatnonzero(jump) + 1
            a, b = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r1[a]), pa.array(r2[a]), pa.array(start[a].astype(np.int64)), pa.array(start[b].astype(np.int64)), pa.array(np.full(len(a), k, np.int32))],
                ["r1", "r2", "lo", "hi", "deep"],
            )


_RANGES = "r1 bigint, r2 bigint, lo bigint, hi bigint, deep int"


def indexed_ranges(cut: DataFrame, length: int, report_length: int) -> DataFrame:
    """Ranges of window starts that occur elsewhere too, by families of suffix arrays.

    deep is 0 for windows of report_length and 1 for those of length.
    """
    dealt = cut.drop("hot").repartition("key").sortWithinPartitions("key")

    def run(batches):
        shard, key = _Shard((report_length, length)), None
        for keys, raws, r1, r2, lo, hi, single in _whole_keys(batches):
            # rows before the first change go on with the minimiser at hand; those after the last may go on
            change = np.flatnonzero(np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]]))
            cuts = [0, *change[[0, -1]].tolist(), len(keys)] if len(change) else [0, len(keys)]
            for k, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if k:
                    yield from shard.ranges()
                    shard = _Shard((report_length, length))
                if p < q:
                    shard.add(raws[p:q], r1[p:q], r2[p:q], lo[p:q], hi[p:q], single[p:q])
            key = keys[-1]
        yield from shard.ranges()

    return dealt.mapInArrow(run, _RANGES)


def counted_ranges(cut: DataFrame, length: int, report_length: int, work: Scratch) -> DataFrame:
    """The same for minimisers with very many contents: windows as rows, counted by fingerprints."""

    def run(batches):
        for batch in slices(batches):
            raws = batch.column("raw").to_pylist()
            for a, b in _batches(batch.column("key").to_numpy(), np.array([len(x) for x in raws])):
                part = batch.slice(a, b - a)
                raw = np.frombuffer(b"".join(raws[a:b]), np.uint8)
                size = np.array([len(x) for x in raws[a:b]])
                begin, lo, hi = np.cumsum(size) - size, part.column("lo").to_numpy(), part.column("hi").to_numpy()
                for deep, depth in enumerate((report_length, length)):
                    n = np.maximum(0, np.minimum(hi - lo + 1, size - depth + 1))
                    who = np.repeat(np.arange(b - a), n)
                    nth = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                    prints = [w.hashes(raw, depth)[begin[who] + nth].view(np.int64) for w in WINDOWS]
                    kept = part.select(["key", "r1", "r2", "single"]).take(pa.array(who))
                    columns = [kept.column("key"), *(pa.array(p) for p in prints), kept.column("r1"), kept.column("r2"), kept.column("single"), pa.array((lo[who] + nth).astype(np.int64)), pa.array(np.full(len(who), deep, np.int32))]
                    out = pa.RecordBatch.from_arrays(columns, ["key", "p1", "p2", "r1", "r2", "single", "lo", "deep"])
                    yield from slices([out])

    windows = cut.drop("hot").mapInArrow(run, "key bigint, p1 bigint, p2 bigint, r1 bigint, r2 bigint, single boolean, lo bigint, deep int")
    print_ = ["key", "deep", "p1", "p2"]
    several = work.store("counted", windows.groupBy(*print_).agg(F.count("*").alias("n")).where("n > 1").select(*print_))
    return windows.where("single").join(several.hint("merge"), print_).select("r1", "r2", "lo", F.col("lo").alias("hi"), "deep")


def repeated_ranges(
    rows: DataFrame, length: int, report_length: int, gram: int, hot_contents: int, work: Scratch
) -> DataFrame:
    """(r1, r2, lo, hi, deep): ranges of starts of repeated windows of each row.

    deep: 0 for windows of report_length, 1 for those of length, 2 for both
    (those of length where the text is long enough).
    """
    found = work.store("stretches", find_stretches(rows, length, report_length, gram))
    keys = found.where("n > 0").groupBy("key").agg(F.sum("n").alias("places"), F.min("content").alias("least"), F.max("content").alias("most"))
    # written first: a join right after the aggregate could not be split where a key is hot
    keys = work.store("keys", keys.where("places > 1").select("key", (F.col("least") != F.col("most")).alias("open")))
    sure = found.where("n = 0").select("r1", "r2", "lo", "hi")
    shared = work.store("shared", found.where("n > 0").join(keys.hint("merge"), "key"))
    sure = work.store("sure", sure.unionByName(shared.where("not open").select("r1", "r2", "lo", "hi")))
    work.drop("stretches", "keys")
    places = ["r1", "r2", "lo", "hi"]
    contents = shared.where("open").groupBy("key", "content").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in places])
    contents = work.store("contents", contents)
    folded = contents.where("n > 1").select("key", "content")
    again = work.store("again", shared.where("open").join(folded.hint("merge"), ["key", "content"]).select(*places))
    work.drop("shared")
    hot = contents.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > hot_contents).select("key", F.lit(True).alias("hot"))
    hot = work.store("hot", hot)
    marked = contents.join(hot, "key", "left").select("key", F.coalesce("hot", F.lit(False)).alias("hot"), (F.col("n") == 1).alias("single"), *places)
    cut = work.store("cut", cut_contents(rows, marked, length))
    work.drop("contents")
    ranges = indexed_ranges(cut.where("not hot"), length, report_length)
    if not hot.isEmpty():
        ranges = ranges.unionByName(counted_ranges(cut.where("hot"), length, report_length, work))
    both = sure.unionByName(again).select("r1", "r2", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), F.lit(2).alias("deep"))
    return ranges.unionByName(both)


def _spans(ranges: list[dict], deep: int, length: int, n_bytes: int) -> list[tuple[int, int]]:
    """The maximal spans that the windows of one length cover."""
    spans: list[list[int]] = []
    for lo, hi in sorted((r["lo"], min(r["hi"] + length, n_bytes)) for r in ranges if r["deep"] in (deep, 2)):
        if hi - lo < length:
            continue
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return [tuple(s) for s in spans]


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    report_length: int = REPORT_LENGTH,
    gram: int = GRAM,
    hot_contents: int = HOT_CONTENTS,
    keep_bytes: bool = False,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated[, kept, spans]) of each row.

    n_repeated counts the bytes covered by strings of ``report_length`` bytes
    that also start elsewhere: what stays because its repeats are too short.
    """
    if not gram < report_length <= length or 2 * length + BATCH_BYTES >= 1 << 16:
        raise ValueError("gram < report_length <= length is asked for, and length below 2,700")
    rows = _row_ids(docs, id_col, text_col)
    work = Scratch(docs.sparkSession, "suffixes")
    ranges = repeated_ranges(rows, length, report_length, gram, hot_contents, work)
    by_row = work.store("ranges", ranges.groupBy("r1", "r2").agg(F.collect_set(F.struct("lo", "hi", "deep")).alias("ranges")))
    work.drop("cut", "sure", "again", "hot")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "kept", "spans")}
            for raw, found in zip(_bytes(batch), batch.column("ranges").to_pylist(), strict=True):
                spans = _spans(found or [], 1, length, len(raw))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                covered = sum(b - a for a, b in _spans(found or [], 0, report_length, len(raw)))
                row = (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), covered, kept, [{"start": a, "end": b} for a, b in spans])
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_repeated": pa.int64()}
            if keep_bytes:
                types |= {"kept": pa.binary(), "spans": span}
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(out[k], t) for k, t in types.items())], ["id", *types])

    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated bigint"
    if keep_bytes:
        schema += ", kept binary, spans array<struct<start:bigint,end:bigint>>"
    joined = rows.join(by_row.hint("merge"), ["r1", "r2"], "left").select("id", "text", "ranges")
    return joined.mapInArrow(run, schema).withColumnRenamed("id", id_col)
