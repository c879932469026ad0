"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is normalised (lower case, white space collapsed and trimmed) and taken
as its words.  A line is removed if an earlier line, in the order of (id, line
number), equals it, or if both have ``near_words`` words at least and one word
replaced, inserted or left out makes them equal.  Lines of fewer than
``min_words`` words stay.  Every line is judged against the input, so a
removed line still removes later ones.

The join:

1. Equal lines fold into classes with their earliest place.
2. Pigeonhole filter: one edit leaves the first or the second half of a line's
   words as they were.  Lines none of whose halves occur in a different line
   need no neighbourhood.
3. The others emit their deletion variants, for words of the half that may
   differ, as hashed keys.  Lines of equal length that agree after leaving out
   the word at the same place are all within one edit of each other, and a line
   is within one edit of all that become it by leaving out a word.  So the
   earliest place per key is witness enough for the whole group, and no pairs
   within groups are formed: a key held by a third of all lines costs one
   aggregate row a task.
4. Each line and its witness meet once and their edit distance is verified on
   the words (common prefix and suffix).

Edge cases: null and empty texts have no lines and stay as they are; blank
lines stay; repeated rows of an id hold the same places and so remove nothing
from each other; rows without an id are neither judged nor changed; other
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick

MIN_WORDS = 3
NEAR_WORDS = 8


def exploded(docs: DataFrame) -> DataFrame:
    """(the columns but text, line, norm): the normalised lines of the text column.

    Lower case, white space collapsed and trimmed, on the whole text, so that
    lines are made once by the explode.  A split array is never empty: the
    outer explode only spares a second evaluation in an inferred filter.
    """
    rest = [c for c in docs.columns if c != "text"]
    low = docs.select(*rest, F.lower("text").alias("low"))
    text = F.col("low")
    odd = text.startswith(" ") | text.endswith(" ")
    for mark in ("  ", "\n ", " \n", "\t", "\r", "\f", "\x0b"):
        odd = odd | text.contains(mark)
    even = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), r"(?m)^ | $", "")
    lines = F.split(F.when(odd, even).otherwise(text), "\n", -1)
    return low.select(*rest, F.posexplode_outer(lines).alias("line", "norm"))


def _n_words(norm: Column) -> Column:
    return F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, line, norm, n) of each line of min_words words at least; docs as (id, text)."""
    cut = exploded(docs.select("id", "text"))
    return cut.where("norm != ''").withColumn("n", _n_words(F.col("norm"))).where(F.col("n") >= min_words)


def _head(norm: Column, k: Column) -> Column:
    """The first k words."""
    return F.call_function("substring_index", norm, F.lit(" "), k)


def _tail(norm: Column, k: Column) -> Column:
    """The last k words."""
    return F.call_function("substring_index", norm, F.lit(" "), -k)


def half_key(side: int, m: Column) -> Column:
    """Key of the first or the last half, for pairs whose shorter line has m words."""
    h = F.floor(m / 2).cast("int")
    part = _head(F.col("norm"), h) if side == 0 else _tail(F.col("norm"), h)
    return F.xxhash64(F.lit(side), m, part)


def line_keys(lines: DataFrame, near_words: int) -> DataFrame:
    """(id, line, h1, h2, halves): hashes of the line and, for near lines, of its halves.

    halves holds (first, last) for the line as the shorter one of a pair, then
    as the longer one, where the shorter has a word less.
    """
    n = F.col("n")
    own = F.array(half_key(0, n), half_key(1, n))
    less = F.array(half_key(0, n - 1), half_key(1, n - 1))
    halves = F.when(n > near_words, F.concat(own, less)).when(n == near_words, own)
    return lines.select(
        "id", "line", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"),
        halves.alias("halves"),
    )


def exact_lines(keys: DataFrame) -> DataFrame:
    """(id, line, first): lines that an earlier one equals."""
    place = F.struct("id", "line")
    classes = keys.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    several = classes.where("n > 1").select("h1", "h2", "first")
    return (
        keys.select("id", "line", "h1", "h2").join(several.hint("merge"), ["h1", "h2"])
        .where(place != F.col("first")).select("id", "line", "first")
    )


def open_lines(keys: DataFrame) -> DataFrame:
    """(id, line, open): which of its halves a line shares with a different line."""
    flat = keys.where("halves is not null").select("id", "line", "h1", F.posexplode("halves").alias("half", "key"))
    shared = flat.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
    return flat.join(shared.hint("merge"), "key").groupBy("id", "line").agg(F.collect_set("half").alias("open"))


def near_lines(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(id, line, norm, n, open) of the opened lines; docs as (id, text)."""
    by_doc = opened.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("line", "open"))).alias("lines"))
    cut = exploded(docs.join(by_doc.hint("merge"), "id"))
    own = cut.select("id", "line", "norm", F.col("lines")[F.col("line")].alias("open"))
    return own.where("open is not null").withColumn("n", _n_words(F.col("norm"))).distinct()


def variants(near: DataFrame) -> DataFrame:
    """(key, check, role, id, line): deletion variants of the half that may differ.

    role s: same length, the word at a fixed place left out; a: the whole of a
    shorter line; b: a longer line with a word left out.
    """
    n, norm = F.col("n"), F.col("norm")
    half = near.select("id", "line", "norm", "n", F.explode("open").alias("half"))
    half = half.withColumn("m", F.when(F.col("half") < 2, n).otherwise(n - 1))
    h = F.floor(F.col("m") / 2).cast("int")
    first = F.when(F.col("half") % 2 == 0, h + 1).otherwise(F.lit(1))
    last = F.when(F.col("half") % 2 == 0, n).otherwise(n - h)
    # place 0 stands for the whole line, for lines that may be the shorter ones
    whole = F.when(F.col("half") < 2, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    placed = half.withColumn("i", F.explode(F.concat(whole, F.sequence(first, last))))
    i = F.col("i")
    left = F.when(i == 0, norm).otherwise(F.concat_ws(" ", F.when(i > 1, _head(norm, i - 1)), F.when(i < n, _tail(norm, n - i))))
    role = F.when(i == 0, "a").when(F.col("half") < 2, "s").otherwise("b")
    made = placed.select("id", "line", "m", role.alias("role"), left.alias("left"), F.when(role == "s", i).otherwise(F.lit(0)).alias("at"))
    key = lambda seed: F.xxhash64(F.lit(seed), "m", "at", F.col("role") == "s", "left")
    return made.select(key(3).alias("key"), key(7).alias("check"), "role", "id", "line")


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """One word replaced, inserted or left out at most; a and b are arrays of words."""
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (
        _common(a, b) + _common(F.reverse(a), F.reverse(b)) >= longer - 1
    )


def near_pairs(near: DataFrame, work: Scratch) -> DataFrame:
    """(id, line, first): lines within one edit of an earlier one, verified on the words."""
    place = F.struct("id", "line")
    emitted = variants(near)
    role = F.col("role")
    best = emitted.groupBy("key", "check").agg(
        *[F.min(F.when(role == r, place)).alias(r) for r in "sab"],
        F.max(F.when(role == "s", place)).alias("last"),
    )
    best = best.where("s != last or (a is not null and b is not null)").drop("last")
    witness = F.when(role == "s", F.col("s")).when(role == "a", F.col("b")).otherwise(F.col("a"))
    pairs = (
        emitted.join(best.hint("merge"), ["key", "check"])
        .select("id", "line", witness.alias("first")).where(F.col("first") < place)
        .groupBy("id", "line").agg(F.min("first").alias("first"))
    )
    pairs = work.store("pairs", pairs)
    words = near.select("id", "line", F.split("norm", " ").alias("w"))
    other = words.select(F.col("id").alias("o_id"), F.col("line").alias("o_line"), F.col("w").alias("o_w"))
    met = pairs.join(words.hint("merge"), ["id", "line"]).join(
        other.hint("merge"), (F.col("first.id") == F.col("o_id")) & (F.col("first.line") == F.col("o_line"))
    )
    return met.where(within_one_edit(F.col("w"), F.col("o_w"))).select("id", "line", "first")


def removed_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    near_words: int = NEAR_WORDS,
) -> DataFrame:
    """A row per removed line: (id, line, kind, kept_id, kept_line); kind is exact or near."""
    source = pick(docs, id=id_col, text=text_col).where("id is not null and text is not null")
    work = Scratch(docs.sparkSession, "lines")
    keys = work.store("keys", line_keys(lines_of(source, min_words), near_words))
    exact = work.store("exact", exact_lines(keys))
    opened = open_lines(keys).join(exact.select("id", "line").hint("merge"), ["id", "line"], "left_anti")
    near = work.store("near", near_lines(source, opened))
    work.drop("keys")
    verified = work.store("verified", near_pairs(near, work).withColumn("kind", F.lit("near")))
    work.drop("near", "pairs")
    both = exact.withColumn("kind", F.lit("exact")).unionByName(verified)
    return both.distinct().select(
        F.col("id").alias(id_col), "line", "kind",
        F.col("first.id").alias("kept_id"), F.col("first.line").alias("kept_line"),
    )


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    near_words: int = NEAR_WORDS,
    drop_emptied: bool = True,
) -> DataFrame:
    """The documents without their removed lines, all columns kept.

    A document that loses lines and keeps no word goes if drop_emptied.
    """
    gone = removed_lines(docs, id_col, text_col, min_words, near_words)
    by_doc = gone.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.collect_set("line").alias("__gone"))
    by_doc = Scratch(docs.sparkSession, "gone-lines").store("by-doc", by_doc)
    joined = docs.join(by_doc.hint("merge"), docs[f"`{id_col}`"] == F.col("__id"), "left")
    text = F.col(f"`{text_col}`")
    kept = F.array_join(
        F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n"
    )
    result = F.when(F.col("__gone").isNull(), text).otherwise(kept)
    columns = [result.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if drop_emptied:
        joined = joined.where(F.col("__gone").isNull() | kept.rlike(r"\S"))
    return joined.select(*columns)
