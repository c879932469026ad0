"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

A test item of n characters may occur in a document with up to
``k = floor(rate * n)`` edits.  Cut into k + 1 pieces, at least one piece then
occurs unchanged.  An Aho-Corasick automaton over all pieces finds the hits in
one pass over each whole text; around each hit a window is verified by Myers'
algorithm (one machine word per item, as long as the item).

Items are read in blocks of at most ``block_chars`` characters; the automaton
of one block travels with the tasks, and each further block is another pass.

Case and white space are folded character by character, so offsets are those
of the text.  Edge cases: null and empty texts or items match nothing; repeated
documents are reported each; an item that occurs several times in a document
is reported for each separate place; only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame

from .common import arrow_map, pick

EDIT_RATE = 0.05
BLOCK_CHARS = 4_000_000

def fold(text: str | None) -> str:
    """Lower case, white space as spaces; the length stays."""
    low = (text or "").lower()
    if len(low) != len(text or ""):  # a few capitals have longer lower-case forms: keep those
        low = "".join([c if len(x := c.lower()) != 1 else x for c in text])
    for blank in "\n\t\r\x0b\x0c\xa0":
        if blank in low:
            low = low.replace(blank, " ")
    return low


def budget(n: int, rate: float) -> int:
    return int(n * rate)


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 spans that cover n characters, as even as can be."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Pattern:
    """Myers' masks of a pattern, forwards and backwards."""

    def __init__(self, text: str):
        self.n = len(text)
        self.masks = [self._masks(text), self._masks(text[::-1])]

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return masks

    def best(self, text: str, backwards: bool = False, anchored: bool = False) -> tuple[int, int]:
        """Least distance of the pattern to a piece of text, and where the first such piece ends.

        anchored: the piece has to begin where the text does.
        """
        masks, n = self.masks[backwards], self.n
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score = full, 0, n
        least, end = n, 0
        for i, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | ~(xh | plus) & full
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = (ph << 1 | anchored) & full
            mh = mh << 1 & full
            plus = mh | ~(xv | ph) & full
            minus = ph & xv
            if score < least:
                least, end = score, i
        return least, end


class Matcher:
    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items, at = [], {}
        for key, text in items:
            text = fold(text)
            if text.strip():
                k = budget(len(text), rate)
                for a, b in pieces(len(text), k):
                    at.setdefault(text[a:b], []).append((len(self.items), a))
                self.items.append((key, k, Pattern(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item id, start, end, distance) of each separate occurrence."""
        if not self.items or not text:
            return []
        text = fold(text)
        starts: dict[int, list[int]] = {}
        for last, (n, places) in self.automaton.iter(text):
            for item, a in places:
                starts.setdefault(item, []).append(last + 1 - n - a)
        found = []
        for item, begins in starts.items():
            key, k, pattern = self.items[item]
            done = -1  # end of the last occurrence of this item
            begins.sort()
            i = 0
            while i < len(begins):
                # hits whose windows overlap by all but a few characters share one window
                j = i
                while j + 1 < len(begins) and begins[j + 1] - begins[i] <= 2 * k:
                    j += 1
                lo, hi = max(done, begins[i] - k, 0), begins[j] + pattern.n + k
                window = text[lo:hi]
                least, end = pattern.best(window)
                i = j + 1
                if least <= k:
                    back, length = pattern.best(window[:end][::-1], backwards=True, anchored=True)
                    found.append((key, lo + end - length, lo + end, back))
                    done = lo + end
                    while i < len(begins) and begins[i] + pattern.n <= done + k:
                        i += 1
        return sorted(found, key=lambda f: (f[1], f[2], str(f[0])))


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items, partition by partition, in blocks of bounded size."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["id"], row["text"]))
        size += len(row["text"] or "")
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


#: The automaton of the block at hand, kept by a worker between batches.
_matchers: dict[str, Matcher] = {}


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, item_id, start, end, distance): every occurrence of an item within its edit budget."""
    source = pick(docs, id=id_col, text=text_col)
    test = pick(items, id=item_id_col, text=item_text_col)
    id_type, item_type = (x.schema["id"].dataType.simpleString() for x in (source, test))
    schema = f"id {id_type}, item_id {item_type}, start bigint, end bigint, distance int"
    context = docs.sparkSession.sparkContext

    def matches(block: list[tuple]) -> DataFrame:
        shared, key_of_block = context.broadcast(block), uuid.uuid4().hex

        def rows(cols):
            if key_of_block not in _matchers:
                _matchers.clear()
                _matchers[key_of_block] = Matcher(shared.value, rate)
            out = {k: [] for k in ("id", "item_id", "start", "end", "distance")}
            for key, text in zip(cols["id"], cols["text"], strict=True):
                for m in _matchers[key_of_block].find(text):
                    for k, v in zip(out, (key, *m), strict=True):
                        out[k].append(v)
            return out

        return arrow_map(source, rows, schema)

    found = [matches(b) for b in item_blocks(test, block_chars)] or [matches([])]
    return reduce(DataFrame.unionAll, found).withColumnsRenamed({"id": id_col})


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = EDIT_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents without any occurrence, with all their columns, where they are read."""
    context = docs.sparkSession.sparkContext
    at = docs.columns.index(text_col)

    def without(kept: DataFrame, block: list[tuple]) -> DataFrame:
        shared = context.broadcast(block)

        def run(batches):
            import pyarrow as pa

            matcher = Matcher(shared.value, rate)
            for batch in batches:
                keep = [not matcher.find(t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return kept.mapInArrow(run, docs.schema)

    return reduce(without, item_blocks(pick(items, id=item_id_col, text=item_text_col), block_chars), docs)
