"""Best-fit packing planned over the histogram of lengths.

1. Documents become token pieces of at most ``capacity`` ids (tokenizer ids and
   an end id; only longer documents are cut).
2. The histogram of piece lengths, at most ``capacity`` rows whatever the
   input, is packed by best fit decreasing: all pieces of a length are placed
   at once into runs of equal sequences.
3. Pieces take the planned places by their rank within their length.  The rank
   is a base per (length, bucket) plus a row number within that bucket, so a
   length that half of the rows share is still numbered in bounded groups.

Edge cases: null and empty texts are one piece that holds the end id; repeated
rows are packed each; a table without rows gives none; texts are never cut
except into full pieces.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, slices

CAPACITY = 4096
END_ID = 1
#: Rows numbered in one window group, about.
BUCKET_ROWS = 20_000
#: Entries of a generation of a worker's caches of words and of their parts.
CACHE_WORDS = 120_000
CACHE_PARTS = 400_000


class Recent(dict):
    """A cache of two generations: keeps what was used since the last but one overflow."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Token ids as little-endian uint32 bytes.

    The vocabulary's pre-tokenizer never joins across white space, so a text's
    ids are those of its words in order.  Words of plain letters, digits and
    signs are cut by the vocabulary's own pattern and each part goes straight
    to its BPE model; other words go through the whole tokenizer, and so do
    texts that hold the literal of an added token, which has an id of its own.
    """

    _PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
    # Fixed by the vocabulary: contractions, letters, one digit, other signs.
    _PARTS = re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017f0-9]+"
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # byte-level alphabet: printable bytes stand for themselves, others follow from 256 on
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = (b for b in range(256) if b not in shown)
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.parts = Recent(CACHE_PARTS, self._part)
        self.words = Recent(CACHE_WORDS, self._word)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join([self.alphabet[b] for b in part.encode()])
        return struct.pack(f"<{len(t := self.model.tokenize(part))}I", *[x.id for x in t])

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if self._PLAIN.fullmatch(word):
            return b"".join([self.parts[p] for p in self._PARTS.findall(word.lower())])
        return self._whole(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.words
        return [
            self._whole(t) if any(a in t for a in self.added)
            else b"".join([ids[w] for w in t.replace("\n", " ").split(" ")])
            for t in texts
        ]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the token pieces of each document."""
    source = pick(docs, id=id_col, text=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    end = np.asarray([end_id], "<u4").tobytes()
    if keep_ids:
        schema += ", ids binary"

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(enc.encode(texts)):
                ids += end
                for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[b : b + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(b // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    kept.append(part)
            arrays = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                arrays.append(pa.array(kept, pa.binary()))
            names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


@dataclass
class Run:
    """Ranks [first, first + count) of a length: ``per`` to a sequence, from ``sequence`` at ``offset``."""

    length: int
    first: int
    count: int
    per: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best fit decreasing over counts; sequences are numbered from 0.

    ``free[r]`` lists blocks (first sequence, number of sequences) with r places
    left.  A length goes to the tightest blocks first and fills each sequence
    with as many pieces as fit before the next, as one-by-one best fit would.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    runs: list[Run] = []
    total = 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                insort(sizes, room)
            free[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                room = sizes[i]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], sizes[i]
            else:
                room, first = capacity, total
                n = -(-left // (capacity // length))
                total += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append(Run(length, rank, full * per, per, first, capacity - room))
                give(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n:
                if left:  # fewer than per are left: they open one more sequence
                    runs.append(Run(length, rank, left, left, first + full, capacity - room))
                    give(room - left * length, first + full, 1)
                    full, rank, left = full + 1, rank + left, 0
                give(room, first + full, n - full)
    return runs


def ranked(pieces: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with ``rank``: 0, 1, ... within each length, numbered in bounded groups."""
    n = pieces.groupBy("length").agg(F.count("*").alias("n_length"))
    hashed = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.ceil(F.col("n_length") / bucket_rows))
    # one row per length, at most `capacity` of them
    dealt = pieces.join(F.broadcast(n), "length").withColumn("bucket", hashed).drop("n_length")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n_bucket"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n_bucket").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    numbered = dealt.withColumn("row", F.row_number().over(within) - 1)
    return numbered.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("row")).drop("bucket", "row", "base")


def place(rows: DataFrame, runs: list[Run]) -> DataFrame:
    """Join ranked pieces to the planned runs: adds sequence_id and offset.

    The plan has a few runs per length at most, so it travels with the tasks.
    """
    runs = sorted(runs, key=lambda r: (r.length, r.first))
    table = np.array([(r.length, r.first, r.count, r.per, r.sequence, r.offset) for r in runs], np.int64).reshape(-1, 6)
    plan_table = rows.sparkSession.sparkContext.broadcast(table)
    names = [c for c in rows.columns if c != "rank"]
    fields = [rows.schema[c] for c in names]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id bigint, offset bigint"

    def run(batches):
        t = plan_table.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            # binary search for the run of each rank among those of its length
            lo = np.searchsorted(t[:, 0], length, "left")
            hi = np.searchsorted(t[:, 0], length, "right")
            while (open_ := hi - lo > 1).any():
                mid = (lo + hi) // 2
                up = open_ & (t[np.minimum(mid, len(t) - 1), 1] <= rank)
                lo, hi = np.where(up, mid, lo), np.where(open_ & ~up, mid, hi)
            r = t[lo]
            nth = rank - r[:, 1]
            sequence = r[:, 4] + nth // r[:, 3]
            offset = r[:, 5] + nth % r[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return rows.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, [ids,] sequence_id, offset)."""
    pieces = tokenize_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, keep_ids)
    pieces = Scratch(docs.sparkSession, "packing").store("pieces", pieces.withColumnRenamed(id_col, "id"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(ranked(pieces), plan(counts, capacity)).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): sequences put together from pieces packed with keep_ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, x: F.concat(a, x))
    return grouped.select("sequence_id", "length", ids.alias("ids"))


def word_bpe_path(spark: SparkSession | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
