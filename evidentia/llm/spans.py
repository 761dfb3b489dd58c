"""Native match positions: spans of a regular expression as array columns, without Python.

`split` gives the gaps between the matches that `regexp_extract_all` gives, so a running sum
of their lengths gives each match's start in code points. The sum runs over slices of the
array, so that a text of very many matches costs little more than its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.binding import let

SPAN = "array<struct<start:int,stop:int,kind:string,rank:int>>"
_SLICE = 256
#: Code points of a piece of a text that is read at many places.
PIECE = 1024


def _sum(a: Column, b: Column) -> Column:
    return a + b


def running(steps: Column, join: Callable[[Column, Column], Column] = _sum) -> Column:
    """What `join` makes of all elements before each element of an int array, starting from 0."""

    def slices(xs: Column) -> Column:
        empty = F.array().cast("array<int>")

        def part(state: Column, k: Column) -> Column:
            inner = F.aggregate(
                F.slice(xs, k * _SLICE + 1, F.lit(_SLICE)),
                F.struct(state["s"].alias("s"), empty.alias("a")),
                lambda acc, x: F.struct(join(acc["s"], x).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")),
            )
            return let(inner, lambda i: F.struct(i["s"].alias("s"), F.array_append(state["a"], i["a"]).alias("a")))

        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<array<int>>").alias("a"))
        numbers = F.sequence(F.lit(0), F.ceil(F.size(xs) / _SLICE).cast("int") - 1)
        return F.when(F.size(xs) == 0, empty).otherwise(
            F.flatten(F.aggregate(numbers, start, part, lambda acc: acc["a"]))
        )

    return let(steps, slices)


def matches(text: Column, pattern: str | Column) -> Column:
    """All non-overlapping matches of `pattern` as structs (start, stop, match), stop exclusive."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
            return let(
                running(steps),
                lambda before: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(before, i) + F.length(F.get(gaps, i))).alias("start"),
                        (F.get(before, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("stop"),
                        m.alias("match"),
                    ),
                ),
            )

        return let(F.split(text, pattern, -1), with_gaps)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def spans(text: Column, pattern: str | Column, kind: str | Column, rank: int, good: Callable[[Column], Column] | None = None) -> Column:
    """All non-overlapping matches of `pattern` as structs (start, stop, kind, rank), stop exclusive.

    `good` says of a match's text whether to keep it; dropped matches still consume their text.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    found = matches(text, pattern)
    kept = F.filter(found, lambda s: good(s["match"])) if good else found
    return F.transform(
        kept,
        lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), kind.alias("kind"), F.lit(rank).alias("rank")
        ),
    )


def none() -> Column:
    return F.array().cast(SPAN)


def in_order(found: Column) -> Column:
    """Spans by start, then rank, then stop."""
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["rank"], s["stop"], s["kind"])))


def outside(found: Column, base: Column) -> Column:
    """The spans of `found` that overlap none of `base`: one sweep over both in order of place."""
    marked = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["stop"], s["kind"], F.lit(own).alias("own")))

    def swept(parts: Column) -> Column:
        far = F.lit((1 << 31) - 1)
        back = running(F.transform(parts, lambda s: F.when(s["own"], 0).otherwise(s["stop"])), F.greatest)
        # places counted from the far end, so that what begins first after a part is a greatest value too
        ahead = F.reverse(running(F.reverse(F.transform(parts, lambda s: F.when(s["own"], 0).otherwise(far - s["start"]))), F.greatest))
        sides = F.struct(back.alias("back"), ahead.alias("ahead"))
        apart = lambda s, i, x: (F.get(x["back"], i) <= s["start"]) & ((F.get(x["ahead"], i) == 0) | (far - F.get(x["ahead"], i) >= s["stop"]))
        kept = let(sides, lambda x: F.filter(parts, lambda s, i: s["own"] & apart(s, i, x)))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["rank"].alias("rank")))

    return F.when(F.size(base) == 0, found).otherwise(let(F.array_sort(F.concat(marked(found, True), marked(base, False))), swept))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, by start and then rank, comma-joined."""
    return F.array_join(
        F.transform(in_order(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def pieces(text: Column) -> Column:
    """`text` in pieces of PIECE code points, for `part`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def part(held: Column, start: Column, stop: Column) -> Column:
    """Code points `start` to `stop` of a text in pieces: as long as the part takes, wherever in the text it lies."""
    first = F.floor(start / PIECE).cast("int")
    count = F.greatest(F.ceil(stop / PIECE).cast("int") - first, F.lit(0))
    joined = F.array_join(F.slice(held, first + 1, count), "")
    return F.when(stop > start, F.substring(joined, start - first * PIECE + 1, stop - start)).otherwise("")


def replaced(text: Column, found: Column, mark: Callable[[Column], Column]) -> Column:
    """`text` with each span replaced by `mark(kind)`; overlapping spans become one, named by the first."""

    def rebuilt(ordered: Column) -> Column:
        def with_reach(reach: Column) -> Column:
            # a span inside what earlier ones reach adds nothing but its own reach
            gap = lambda held, s, i: part(held, F.get(reach, i), s["start"])
            fresh = lambda s, i: s["start"] >= F.get(reach, i)
            one = lambda held: lambda s, i: F.when(fresh(s, i), F.concat(gap(held, s, i), mark(s["kind"]))).otherwise("")
            end = F.array_max(F.transform(ordered, lambda s: s["stop"]))
            rest = lambda held: part(held, end, F.length(text))
            return let(pieces(text), lambda held: F.concat(F.array_join(F.transform(ordered, one(held)), ""), rest(held)))

        return let(running(F.transform(ordered, lambda s: s["stop"]), F.greatest), with_reach)

    return F.when(F.size(found) == 0, text).otherwise(let(in_order(found), rebuilt))
