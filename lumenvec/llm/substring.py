"""Substring dedup by unit hashing: repeated lines and passages, earliest kept.

Units are all lines (or paragraphs) that hold a word (``min_words`` raises that)
and, since a passage may be copied into the middle of a line, spans of
``span_words`` words that begin at content-defined places: of ``window``
neighbouring starting places the one with the least hash of its first two words
begins a span.  Two texts that share a run of span_words + window - 1 words (48)
share a span, and texts that share fewer than span_words (25) in a row share
none but equal lines.  Neighbouring spans begin ``window`` words apart at most,
one less than a span has, so they leave no hole between them.

Units are normalised (lower case, white space collapsed and trimmed) and
digested to 128 bits.  Digests meet globally with the rank (id, row, start) of
their earliest occurrence, where row is a hash of the text, folded on the map side first; every other occurrence is
removed, as spans of the original text (code points, end exclusive).

Edge cases: null and empty texts have no units; blank units are never
removed; a unit repeated within one document keeps its first place; a
null id ranks last; rows of one id, or without one, are told apart by their
texts; rows that repeat an id and a text repeat its places, and those count as
one occurrence; only the id and text columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, pick, slices

MIN_WORDS = 1
SPAN_WORDS = 25
WINDOW = 24
_SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
_WORD = re.compile(r"\S+")
_LINE_SEED, _SPAN_SEED = 1, 2
_BASES = tuple(np.array([b], np.uint64) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def _powers(base: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def least_places(g: np.ndarray, window: int) -> np.ndarray:
    """Of each window of g the place of its least value (the first of equals), once each."""
    if len(g) < window:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(np.arange(len(view)) + view.argmin(1))


def cut(
    text: str | None, unit: str = "line", min_words: int = MIN_WORDS, span_words: int = SPAN_WORDS, window: int = WINDOW
) -> list[tuple[int, int, int, int]]:
    """(start, end, digest high, digest low) of the units of a text."""
    if not text:
        return []
    out, at, mark = [], 0, _SEPARATORS[unit]
    for part in text.split(mark):
        words = part.lower().split()
        if len(words) >= min_words:
            d = xxhash.xxh3_128_intdigest(" ".join(words), _LINE_SEED)
            out.append((at, at + len(part), d >> 64, d & (1 << 64) - 1))
        at += len(part) + len(mark)
    matches = [m.span() for m in _WORD.finditer(text)]
    n = len(matches) - span_words + 1  # starting places
    if n >= window:
        h = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b].lower(), _SPAN_SEED) for a, b in matches), np.uint64, len(matches))
        g = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] >> np.uint64(7))
        starts = least_places(g[:n], window)
        pairs = []
        for base in _BASES:
            powers = _powers(base, span_words)
            pairs.append((np.lib.stride_tricks.sliding_window_view(h, span_words)[starts] * powers).sum(1, dtype=np.uint64))
        for s, hi, lo in zip(starts.tolist(), pairs[0].tolist(), pairs[1].tolist(), strict=True):
            out.append((matches[s][0], matches[s + span_words - 1][1], hi, lo))
    return out


def row_key(text) -> Column:
    """With the id it tells rows apart; text is a column or its name."""
    return F.xxhash64(F.lit(3), text)


def units(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id, row, start, end, d1, d2) of each unit."""

    def rows(cols):
        keys, row, found = [], [], []
        for key, r, text in zip(cols["id"], cols["row"], cols["text"], strict=True):
            own = cut(text, **how)
            found += own
            keys += [key] * len(own)
            row += [r] * len(own)
        start, end, d1, d2 = zip(*found, strict=True) if found else ((), (), (), ())
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return {"id": keys, "row": row, "start": start, "end": end, "d1": signed(d1), "d2": signed(d2)}

    source = pick(docs, id=id_col, text=text_col).select("id", row_key("text").alias("row"), "text")
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, rows, f"id {kind}, row bigint, start bigint, end bigint, d1 bigint, d2 bigint")


def repeated_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    min_words: int = MIN_WORDS,
    span_words: int = SPAN_WORDS,
    window: int = WINDOW,
) -> DataFrame:
    """A row per removed unit: (id, row, start, end, kept_id, kept_start).

    Offsets are those of the original text; kept_* is the earliest occurrence.
    """
    how = {"unit": unit, "min_words": min_words, "span_words": span_words, "window": window}
    work = Scratch(docs.sparkSession, "units")
    found = work.store("units", units(docs, id_col, text_col, **how))
    # null ids rank last: the flag comes before the id
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    seen = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    # written first: a join right after the aggregate could not be split where a digest is hot
    several = work.store("repeated", seen.where("n > 1").select("d1", "d2", "first"))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))
    return (
        found.join(several, ["d1", "d2"])
        .where(~(own & (F.col("start") == F.col("first.start"))))
        .select(
            F.col("id").alias(id_col), "row", "start", "end",
            F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"),
        )
    )


def removed_spans(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Removed units merged by document: (id, row, n_units, n_chars, spans, kept_ids).

    spans: array of (start, end), disjoint and in order; kept_ids: the
    documents that keep what is removed here, at most one per unit.
    """
    source = removed.withColumnRenamed(id_col, "id")
    own = source.groupBy("id", "row").agg(
        F.count("*").alias("n_units"),
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("units"),
        F.sort_array(F.collect_set("kept_id")).alias("kept_ids"),
    )
    kind = own.schema["id"].dataType.simpleString()
    kept = own.schema["kept_ids"].dataType.simpleString()

    def rows(cols):
        spans = []
        for found in cols["units"]:
            merged: list[list[int]] = []
            for u in found:
                if merged and u["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], u["end"])
                else:
                    merged.append([u["start"], u["end"]])
            spans.append([{"start": a, "end": b} for a, b in merged])
        chars = [sum(s["end"] - s["start"] for s in x) for x in spans]
        return {"id": cols["id"], "row": cols["row"], "n_units": cols["n_units"], "n_chars": chars, "spans": spans, "kept_ids": cols["kept_ids"]}

    schema = f"id {kind}, row bigint, n_units bigint, n_chars bigint, spans array<struct<start:bigint,end:bigint>>, kept_ids {kept}"
    return arrow_map(own, rows, schema).withColumnRenamed("id", id_col)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their removed spans, all columns kept; each row loses its own spans."""
    gone = spans.select(F.col(f"`{id_col}`").alias("__id"), F.col("row").alias("__row"), F.col("spans").alias("__gone"))
    same = docs[f"`{id_col}`"].eqNullSafe(F.col("__id")) & (row_key(docs[f"`{text_col}`"]) == F.col("__row"))
    joined = docs.join(gone, same, "left").drop("__id", "__row")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            texts = []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                if text is not None and gone:
                    edges = [0, *(x for s in gone for x in (s["start"], s["end"])), len(text)]
                    text = "".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                texts.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
