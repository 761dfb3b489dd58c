"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be met with up to k = m * rate edits. Cut into k + 1 pieces, at
least one piece stays whole in any such passage. An automaton finds all pieces of all items
in each text, and each place a piece points to is verified with Myers' bit-parallel distance:
first ever larger runs of pieces around the hit, each with its share of the edits, then the item.
Texts and items are compared in lower case with white space runs as one space.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.text import bounded

RATE = 0.1
#: Characters under which an item must stand apart as words.
SHORT = 20
#: Bytes of items held at once; a larger benchmark is matched in blocks of items, a scan for each.
BLOCK_BYTES = 2 << 20
_RUN = re.compile(r"\S+")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of `normal(text)` its place in `text`."""
    out: list[int] = []
    for m in _RUN.finditer(text):
        if out:
            out.append(m.start() - 1)
        for i, c in enumerate(m[0], m.start()):
            out.extend([i] * len(c.lower()))
    return out


def _ends(pattern: str, text: str, most: int, anchored: bool = False) -> Iterator[tuple[int, int]]:
    """(distance, end) for each end in `text` of a passage within `most` edits of `pattern`, by Myers' bit-parallel columns.

    An anchored passage begins where `text` does.
    """
    mask, high = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, first = mask, 0, len(pattern), int(anchored)
    for end, c in enumerate(text, 1):
        same = where.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | (mask & ~(horizontal | up))
        minus = up & horizontal
        score += bool(plus & high) - bool(minus & high)
        plus, minus = plus << 1 | first, minus << 1
        up = (minus | ~(vertical | plus)) & mask
        down = plus & vertical & mask
        if score <= most:
            yield score, end
        elif score - (len(text) - end) > most:  # a character changes the score by one at most
            return


def passages(pattern: str, text: str, most: int, good: Callable[[int, int], bool] = lambda a, b: True) -> list[tuple[int, int, int]]:
    """(distance, start, stop) of passages within `most` edits that `good` accepts, apart from one another.

    Whole ones first, from the left, then those nearest to `pattern`, the first of equals; one that
    `good` refuses hides no other.
    """
    found: list[tuple[int, int, int]] = []
    at = text.find(pattern)
    while at >= 0:
        if good(at, at + len(pattern)):
            found.append((0, at, at + len(pattern)))
            at = text.find(pattern, at + len(pattern))
        else:
            at = text.find(pattern, at + 1)
    if not most:
        return found
    edges = [0, *(x for _, a, b in found for x in (a, b)), len(text)]
    for lo, hi in list(zip(edges[::2], edges[1::2], strict=True)):
        if hi - lo < len(pattern) - most:
            continue
        own: list[tuple[int, int, int]] = []
        for distance, end in sorted(_ends(pattern, text[lo:hi], most)):
            latest = end - len(pattern) + distance  # no passage that ends here begins later
            if any(a < end and latest < b for _, a, b in own):
                continue
            back = text[max(lo, lo + end - len(pattern) - distance) : lo + end][::-1]
            start = end - min(_ends(pattern[::-1], back, distance, anchored=True), default=(0, end))[1]
            if start < end and not any(a < end and start < b for _, a, b in own) and good(lo + start, lo + end):
                own.append((distance, start, end))
        found += [(d, lo + a, lo + b) for d, a, b in own]
    return sorted(found, key=lambda m: m[1])


def _runs(cuts: list[int], piece: int) -> tuple[tuple[int, int, int], ...]:
    """Runs of pieces around `piece`, small to large, as (start, stop, edits), by halving the item.

    A run of n pieces with fewer than n edits has a half of which that is true too, so every
    passage within budget has a whole piece all of whose runs are within theirs.
    """
    lo, hi, found = 0, len(cuts) - 1, []
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if piece < middle else (middle, hi)
        found.append((cuts[lo], cuts[hi], hi - lo - 1))
    return tuple(found[-2::-1])


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float) -> None:
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        pieces: dict[str, list[tuple]] = defaultdict(list)
        for n, (_, t, most) in enumerate(self.items):
            cuts = [len(t) * k // (most + 1) for k in range(most + 2)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                pieces[t[a:b]].append((n, a, _runs(cuts, k)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def _windows(self, clean: str) -> dict[int, list[list[int]]]:
        """Ranges of a text in which each item may lie, overlapping ones as one."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, at) in self.automaton.iter(clean):
            for n, offset, runs in at:
                _, item, most = self.items[n]
                start = end + 1 - size - offset
                if not all(self._near(clean, start, item, run) for run in runs):
                    continue
                lo, hi = max(0, start - most), min(len(clean), start + len(item) + most)
                own = windows.setdefault(n, [])
                if own and lo <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], lo), max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        return windows

    @staticmethod
    def _near(clean: str, start: int, item: str, run: tuple[int, int, int]) -> bool:
        """Whether a run of pieces lies where it should, an item beginning at about `start`, within its edits."""
        a, b, most = run
        passage, part = clean[max(0, start + a - most) : max(0, start + b + most)], item[a:b]
        return part in passage or next(_ends(part, passage, most), None) is not None

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of passages in `text`, places those of the text itself."""
        clean = normal(text)
        back: list[int] = []
        for n, own in self._windows(clean).items():
            item_id, item, most = self.items[n]
            for lo, hi in own:
                apart = lambda a, b, lo=lo: len(item) >= SHORT or self.whole(clean, lo + a, lo + b)  # noqa: E731, B023
                for distance, start, stop in passages(item, clean[lo:hi], most, apart):
                    back = back or places(text)
                    yield item_id, distance, back[lo + start], back[lo + stop - 1] + 1

    @staticmethod
    def whole(text: str, start: int, stop: int) -> bool:
        """Whether a short passage stands apart from the letters and digits around it."""
        return not (start and text[start - 1].isalnum()) and not (stop < len(text) and text[stop].isalnum())


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def _sorted(held: set[tuple[int | None, str]]) -> tuple[tuple[int | None, str], ...]:
    return tuple(sorted(held, key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items (item_id, text) in blocks of bounded size; those without words are left out."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    held: set[tuple[int, str]] = set()
    size = 0
    for r in rows.where("text is not null").toLocalIterator():
        text = normal(r.text)
        if not text:
            continue
        if held and size + len(text) > most:
            yield _sorted(held)
            held, size = set(), 0
        held.add((r.item_id, text))
        size += len(text)
    if held:
        yield _sorted(held)


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, start, stop): passages of `items` in whole texts of `docs`.

    start and stop are code points of the text as it is. Every passage of an item gives a row; those
    that overlap give one, the nearest. Items of under SHORT characters must stand apart as words. Null
    and empty texts and items have none; repeated rows give repeated rows, repeated items one; a null
    doc_id or item_id stays null; columns but ids and texts aren't read, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, start int, stop int"
    found = None
    for block in blocks(items):
        run = _scan(spark.sparkContext.broadcast(block), rate)
        part = source.where("text is not null").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def _scan(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value, rate)
        for batch in bounded(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            rows = [(d, *m) for d, t in zip(ids, batch.column("text").to_pylist(), strict=True) for m in matcher.find(t)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc_id", "item_id", "distance", "start", "stop"]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of `docs` that hold no passage of `items` (see `matches`), in the same columns.

    Texts aren't shuffled. Null and empty texts stay; items without an id count like others; without
    items all rows stay; rows that repeat are each kept or not.
    """
    rows = docs
    for block in blocks(items):
        rows = rows.where(~_holds(docs.sparkSession.sparkContext.broadcast(block), rate)(F.coalesce("text", F.lit(""))))
    return rows


def _holds(shared, rate: float):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        matcher = _matcher(shared.value, rate)
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [next(matcher.find(t), None) is not None for part in bounded([batch], "text") for t in part.column("text").to_pylist()]
        return pa.array(found, pa.bool_())

    return holds
