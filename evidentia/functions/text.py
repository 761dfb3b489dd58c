"""Text expressions: normalisation, quality, agreement and safe-repair tests.

Whitespace means Unicode whitespace with U+001C to U+001F. Where a rule needs NFKC, `nfkc` is an
Arrow function, the only Python here besides the order-dependent `sequence_ratio` and `trim_candidate`.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.binding import let

# Unicode whitespace.
_SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{_SPACES}]"

# The expected script, isolated latin noise and its allow-list, and protected wording.
CJK = r"\x{3005}-\x{3007}\x{303B}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
NOISE_TOKEN = r"(?<![A-Za-z])[a-z]{2,12}(?![A-Za-z])"
ALLOWED_TOKENS = ("rank", "stock", "memo")
PROTECTED = (
    r"(?:第\s*[0-9０-９一二三四五六七八九十百]+(?:条|項|号)?)|"
    r"(?:[0-9０-９一二三四五六七八九十百]+(?:条|項|号|年|月|日))|"
    r"条(?!件)|項|号|年|月|日|円|懲役|禁錮|拘禁刑|最判|大判|判例|事件|昭和|平成|令和"
)


@lru_cache(maxsize=1)
def expected_extra() -> str:
    """Class ranges of letters and numbers that NFKC turns into one ASCII alphanumeric or a list number."""

    def expected(code: int) -> bool:
        c = chr(code)
        if unicodedata.category(c)[0] not in "LN":
            return False
        folded = unicodedata.normalize("NFKC", c)
        if len(folded) == 1 and folded.isascii() and folded.isalnum():
            return True
        digits = folded.removeprefix("(").removesuffix(")")
        return digits.isascii() and digits.isdigit()

    ranges: list[list[int]] = []
    for code in range(0x30, 0x20000):
        if expected(code):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def suspicious_class() -> str:
    """Class of characters that hint at a broken character map."""
    return (
        r"(?U)[\x{FFFD}\x{E000}-\x{F8FF}[\p{L}\p{N}\p{Cc}&&[^" + CJK + expected_extra() + r"\s\x{1C}-\x{1F}]]]"
    )


@lru_cache(maxsize=1)
def _joining() -> frozenset[int]:
    """Code points that NFKC may join to the character before."""
    decompositions = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    pairs = {int(d[1], 16) for d in decompositions if len(d) == 2 and not d[0].startswith("<")}
    return frozenset(pairs | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)})


@lru_cache(maxsize=1)
def stable_ranges() -> list[tuple[int, int]]:
    """Ranges of characters that NFKC leaves alone and never joins to the one before; short ranges are left out."""
    joins = _joining()
    ranges: list[list[int]] = []
    for code in range(0x10000):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or code in joins or unicodedata.combining(c) or not unicodedata.is_normalized("NFKC", c):
            continue
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return [(a, b) for a, b in ranges if a < 0x100 or b - a >= 8]


@lru_cache(maxsize=2)
def stable_class(least: int = 0) -> str:
    """Class ranges of `stable_ranges` that span so many code points."""
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in stable_ranges() if b - a >= least)


def unstable() -> str:
    """Pattern of a character outside `stable_class`.

    Java tries the ranges of a class one by one, so ASCII and the wide ranges are told apart first.
    """
    return rf"(?![\x00-\x7F])(?![{stable_class(100)}])[^{stable_class()}]"


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def nfkc(texts: Column) -> Column:
    """Unicode NFKC, which Spark lacks; only texts with a character that it may change go through Python."""
    return F.coalesce(_nfkc(F.when(texts.rlike(unstable()), texts)), texts)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def character_counts(texts: pa.Array) -> pa.Array:
    """How many characters of a text lie in each of 64 classes of code points; null for null."""
    counts = [None if t is None else np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, minlength=64) for t in texts.to_pylist()]
    return pa.array(counts, pa.list_(pa.int32()))


def _shared(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters from places i and j on are equal, at most so many."""
    n = 0
    while n + 64 <= most and a[i + n : i + n + 64] == b[j + n : j + n + 64]:
        n += 64
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def _ratio(a: str, b: str, least: float = 0.0) -> float | None:
    """`difflib.SequenceMatcher(None, a, b).ratio()`, visiting only the places where a match can start; null below `least`.

    A match starts at a character of both texts that isn't frequent in a long second one, the longest first, then
    grows over frequent ones; what lies before and after it is matched likewise. No more than the shorter of two parts
    can still match, so that unlike texts are soon known to be below `least`.
    """
    if a == b:
        return 1.0
    size, n = len(a) + len(b), len(b)
    if n < 200 and (a in b or b in a):
        found = 2.0 * min(len(a), n) / size
        return found if found >= least else None
    most, held = n // 100 + 1 if n >= 200 else n, set(a)
    places: dict[str, list[int]] = {c: [] for c, k in Counter(b).items() if k <= most and c in held}
    for j, c in enumerate(b):
        if c in places:
            places[c].append(j)
    starts = [i for i, c in enumerate(a) if c in places]
    back_a, back_b = a[::-1], b[::-1]
    matched, open_, left = 0, min(len(a), n), [(0, len(a), 0, n)]
    while left:
        if 2.0 * (matched + open_) / size < least:
            return None
        alo, ahi, blo, bhi = left.pop()
        besti, bestj, best, whole = alo, blo, 0, min(ahi - alo, bhi - blo)
        open_ -= whole
        runs: dict[int, int] = {}
        last = -2
        for i in starts[bisect_left(starts, alo) : bisect_left(starts, ahi)]:
            before, runs = runs if last + 1 == i else {}, {}
            last, spots = i, places[a[i]]
            for j in spots[bisect_left(spots, blo) : bisect_left(spots, bhi)]:
                k = runs[j] = before.get(j - 1, 0) + 1
                if k > best:
                    besti, bestj, best = i - k + 1, j - k + 1, k
            if best == whole:
                break
        grown = _shared(back_a, len(a) - besti, back_b, n - bestj, min(besti - alo, bestj - blo))
        besti, bestj, best = besti - grown, bestj - grown, best + grown
        best += _shared(a, besti + best, b, bestj + best, min(ahi - besti, bhi - bestj) - best)
        if best:
            matched += best
            for part in ((alo, besti, blo, bestj), (besti + best, ahi, bestj + best, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    left.append(part)
                    open_ += min(part[1] - part[0], part[3] - part[2])
    return found if (found := 2.0 * matched / size) >= least else None


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Matching-block ratio of two texts; not symmetric, as frequent characters of a long second text are left out."""
    rows = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([None if x is None or y is None else _ratio(x, y) for x, y in rows], pa.float64())


def ratio_from(least: float) -> Callable[[Column, Column], Column]:
    """`sequence_ratio` as far as it is so much at least, else null."""

    @F.arrow_udf(T.DoubleType())
    def bounded_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else _ratio(x, y, least) for x, y in rows], pa.float64())

    return bounded_ratio


def collapse(text: Column) -> Column:
    """Runs of whitespace as one space, none at the ends. Single spaces, which most are, are no match."""
    return F.trim(F.regexp_replace(text, rf" (?![!-~]){SPACE}+|(?![ -~]){SPACE}+", " "))


def page_text(text: Column) -> Column:
    """Normalised page text."""
    return collapse(nfkc(text))


def comparable(text: Column) -> Column:
    """`page_text`, empty for null."""
    return F.coalesce(page_text(text), F.lit(""))


def compact(text: Column) -> Column:
    """Text without whitespace."""
    return F.regexp_replace(text, SPACE + "+", "")


def strip(text: Column) -> Column:
    """Text without whitespace at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def search_key(text: Column) -> Column:
    """Compact and lower case: what lexical search compares."""
    return F.lower(compact(text))


def profile(text: Column) -> Column:
    """struct(seen, useful, printable, suspicious, script): characters that aren't whitespace, and how many of them are
    no controls, are of no control-like category, hint at a broken character map, and are of the expected script.

    Only plain ASCII makes most texts and is none of the rare kinds, so it is taken out before those are counted.
    """

    def counts(visible: Column) -> Column:
        seen = F.length(visible)
        return let(
            F.regexp_replace(visible, r"[\x21-\x7E]+", ""),
            lambda rest: F.struct(
                seen.alias("seen"),
                (seen - F.regexp_count(rest, F.lit(r"\p{Cc}"))).alias("useful"),
                (seen - F.regexp_count(rest, F.lit(r"\p{C}"))).alias("printable"),
                F.regexp_count(rest, F.lit(suspicious_class())).alias("suspicious"),
                F.length(F.regexp_replace(rest, f"[^{CJK}]+", "")).alias("script"),
            ),
        )

    return let(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), SPACE + "+", ""), counts)


def visible_count(text: Column) -> Column:
    return profile(text)["seen"]


def suspicious_count(text: Column) -> Column:
    """Characters of `suspicious_class`."""
    return F.regexp_count(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x7E]+", ""), F.lit(suspicious_class()))


def useful_count(text: Column) -> Column:
    return profile(text)["useful"]


def noise_tokens(text: Column) -> Column:
    """Isolated lower-case latin tokens that aren't allowed."""
    return F.filter(F.regexp_extract_all(text, F.lit(NOISE_TOKEN), F.lit(0)), lambda t: ~t.isin(*ALLOWED_TOKENS))


def noise_count(text: Column) -> Column:
    return F.size(noise_tokens(text))


def profile_script_ratio(p: Column) -> Column:
    """Share of expected-script characters among visible ones, 0 for none, from a `profile`."""
    return F.when(p["seen"] > 0, p["script"] / p["seen"]).otherwise(0.0)


def profile_quality(p: Column) -> Column:
    """0 to 1: printable share less three times the suspicious share (at most 0.85); 0 for a blank text."""
    penalty = F.least(F.lit(0.85), p["suspicious"] * 3.0 / p["seen"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["printable"] / p["seen"] - penalty))
    return F.when(p["seen"] > 0, F.round(score, 4)).otherwise(0.0)


def script_ratio(text: Column) -> Column:
    return let(profile(text), profile_script_ratio)


def quality(text: Column) -> Column:
    return let(profile(text), profile_quality)


def has_bad_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def is_accurate(text: Column) -> Column:
    """Not empty, and nothing suspicious in it."""
    return F.coalesce((F.length(text) > 0) & (suspicious_count(text) == 0) & (noise_count(text) == 0), F.lit(False))


def agreement(native: Column, seen: Column) -> Column:
    """How two normalised texts agree, or null: equal, one in the other, or the same without whitespace."""
    tight_native, tight_seen = compact(native), compact(seen)
    return (
        F.when(native == seen, "exact")
        .when((F.length(native) >= 2) & seen.contains(native), "native_contained_in_ocr")
        .when((F.length(seen) >= 2) & native.contains(seen), "ocr_contained_in_native")
        .when(tight_native == tight_seen, "exact_ignoring_whitespace")
        .when((F.length(tight_native) >= 2) & tight_seen.contains(tight_native), "native_contained_in_ocr_ignoring_whitespace")
        .when((F.length(tight_seen) >= 2) & tight_native.contains(tight_seen), "ocr_contained_in_native_ignoring_whitespace")
    )


def is_protected(native: Column, candidate: Column) -> Column:
    """Whether a repair would touch articles, dates, money, precedents, or any digit."""
    wording = rf"(?![\x00-/:-\x7F])(?:{PROTECTED})"  # none starts with another ASCII character, and most are such
    return native.rlike(wording) | candidate.rlike(wording) | nfkc(candidate).rlike(r"(?U)\d")


def page_support(candidate: Column, page_ocr: Column) -> Column:
    """Whether the page's own recognised text holds the candidate; null without such a text."""
    tight = compact(nfkc(candidate))
    held = (F.length(tight) > 0) & compact(nfkc(page_ocr)).contains(tight)
    return F.when(F.coalesce(F.length(page_ocr), F.lit(0)) > 0, held)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (removed / F.length(needle)).cast("int")).otherwise(0)


def unique_range(text: Column, needle: Column) -> Column:
    """struct(start, stop) if the needle occurs exactly once, overlaps counted; else null."""
    first = F.instr(text, needle)
    again = F.instr(F.substr(text, first + 1), needle)
    once = (F.length(needle) > 0) & (first > 0) & (again == 0)
    return F.when(once, F.struct((first - 1).alias("start"), (first - 1 + F.length(needle)).alias("stop")))


def line_ranges(text: Column, lines: Column) -> Column:
    """array<struct(line, start, stop)>: each line searched from the end of the last hit; misses don't move the cursor."""
    kind = "array<struct<line:string,start:int,stop:int>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, line: Column) -> Column:
        hit = F.call_function("locate", line, text, state["at"])
        found = F.struct(line.alias("line"), (hit - 1).alias("start"), (hit - 1 + F.length(line)).alias("stop"))
        moved = F.struct((hit + F.length(line)).alias("at"), F.array_append(state["out"], found).alias("out"))
        return F.when(hit > 0, moved).otherwise(state)

    return F.aggregate(lines, start, step, lambda s: s["out"])


def _tight(text: str) -> str:
    return "".join(unicodedata.normalize("NFKC", text).split())


@lru_cache(maxsize=4096)
def _starts(c: str) -> bool:
    """Whether NFKC of a text is that of its parts before and from this character on."""
    return c.isascii() or (unicodedata.normalize("NFKD", c) == c and not unicodedata.combining(c) and ord(c) not in _joining())


def _beside(page: str, at: int, ahead: bool, wanted: int) -> str:
    """What `_tight` makes of the text ahead of a place, or of that before it, as far as `wanted` characters are sure."""
    size = 16
    while True:
        end = min(len(page), at + size) if ahead else max(0, at - size)
        while 0 < end < len(page) and not _starts(page[end]):
            end += 1 if ahead else -1
        found = _tight(page[at:end] if ahead else page[end:at])
        if len(found) >= wanted or end == (len(page) if ahead else 0):
            return found
        size *= 4


def _spot(page: str, needle: str) -> int:
    """Where a literal that isn't empty stands if it does so once, overlaps not counted; else -1."""
    at = page.find(needle)
    return at if at < 0 or page.find(needle, at + len(needle)) < 0 else -1


def _trim(native: str, seen: str, page: str) -> str:
    native_text, seen_text = (unicodedata.normalize("NFKC", t).strip() for t in (native, seen))
    if not native_text or not seen_text:
        return seen_text
    spot, at = native, _spot(page, native)
    if at < 0 and (spot := native.strip()) and spot != native:
        at = _spot(page, spot)
    if at < 0:
        return seen_text
    tight = _tight(seen_text)
    before, after = _beside(page, at, False, 3), _beside(page, at + len(spot), True, 3)
    sizes = range(min(3, len(tight) - 1), 0, -1)
    head = next((n for n in sizes if before.endswith(tight[:n])), 0)
    tail = next((n for n in sizes if after.startswith(tight[-n:])), 0)

    def reach(chars: str, wanted: int) -> int:
        """Characters until `wanted` visible ones have passed."""
        passed = 0
        for n, c in enumerate(chars):
            if passed >= wanted:
                return n
            passed += len(_tight(c))
        return len(chars)

    lo, hi = reach(seen_text, head), len(seen_text) - reach(seen_text[::-1], tail)
    return (seen_text[lo:hi].strip() if lo < hi else "") or seen_text


@F.arrow_udf(T.StringType())
def trim_candidate(native: pa.Array, seen: pa.Array, page: pa.Array) -> pa.Array:
    """Recognised text without up to three characters at either end that repeat what stands beside the native span."""
    rows = zip(native.to_pylist(), seen.to_pylist(), page.to_pylist(), strict=True)
    return pa.array([_trim(n, s, p or "") if n and s else None for n, s, p in rows], pa.string())


_REPAIR = T.StructType().add("candidate", T.StringType()).add("similarity", T.DoubleType()).add("length_ratio", T.DoubleType()).add("support", T.BooleanType())


def _repair(native: str, seen: str, page: str, page_tight: str | None) -> dict:
    candidate = _trim(native, seen, page) if native and seen else None
    if candidate is None:
        return dict.fromkeys(("candidate", "similarity", "length_ratio", "support"))
    a, b = _tight(native), _tight(candidate)
    held = None if page_tight is None else b != "" and b in page_tight
    return {"candidate": candidate, "similarity": _ratio(a, b), "length_ratio": len(b) / max(len(a), 1), "support": held}


@F.arrow_udf(T.ArrayType(_REPAIR))
def page_repairs(native: pa.Array, seen: pa.Array, page: pa.Array, page_ocr: pa.Array) -> pa.Array:
    """What may replace the spans of a page: `trim_candidate`, the `sequence_ratio` and ratio of lengths of span and
    candidate without whitespace, and `page_support`. The spans come as lists, so that a page's texts are sent and
    normalised once.
    """
    kind = pa.list_(pa.struct([("candidate", pa.string()), ("similarity", pa.float64()), ("length_ratio", pa.float64()), ("support", pa.bool_())]))
    found = []
    for ns, ss, p, o in zip(native, seen, page, page_ocr, strict=True):
        text, tight = p.as_py() or "", _tight(o.as_py()) if o.as_py() else None
        found.append(pa.array([[_repair(n, s, text, tight) for n, s in zip(ns.as_py(), ss.as_py(), strict=True)]], kind))
    return pa.concat_arrays(found) if found else pa.array([], kind)


def replace_once(text: Column, edits: Column) -> Column:
    """`text` with each edit struct(target, replacement) whose target occurs exactly once applied; others are left.

    Targets are placed in the text as it was, and replaced from the right.
    """
    placed = F.filter(
        F.transform(edits, lambda e: F.struct(unique_spot(text, e["target"]).alias("spot"), e["replacement"].alias("by"))),
        lambda e: e["spot"].isNotNull(),
    )
    ordered = F.reverse(F.array_sort(placed))
    return F.aggregate(
        ordered,
        text,
        lambda t, e: F.concat(
            F.substr(t, F.lit(1), e["spot"]["start"]), e["by"], F.substr(t, e["spot"]["stop"] + 1)
        ),
    )


def unique_spot(text: Column, target: Column) -> Column:
    """struct(start, stop) of a target that occurs once, as it is or without whitespace at its ends."""
    bare = strip(target)
    spot = F.when(occurrences(text, target) == 1, target).when(occurrences(text, bare) == 1, bare)
    first = F.instr(text, spot)
    return F.when(spot.isNotNull(), F.struct((first - 1).alias("start"), (first - 1 + F.length(spot)).alias("stop")))


def slices(text: Column, size: int = 1800) -> Column:
    """Fixed slices of a text; none for an empty one."""
    count = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def article_number(text: Column) -> Column:
    """Digits of an article reference without leading zeros, null if it isn't one."""
    bare = F.regexp_replace(strip(text), r"^第|条$", "")
    return F.when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+(?=[0-9])", ""))


def safe_component(text: Column, fallback: str = "untitled") -> Column:
    """A file name part: reserved characters as dashes, no dots or spaces at its ends, device names marked, 80 at most."""
    clean = F.regexp_replace(nfkc(text), r'[<>:"/\\|?*\x00-\x1F]+', "-")
    clean = F.substr(F.regexp_replace(clean, r"^[. ]+|[. ]+$", ""), F.lit(1), F.lit(80))
    device = clean.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$")
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, fallback).when(device, F.concat(F.lit("_"), clean)).otherwise(clean)


def page_list(text: Column) -> Column:
    """`1-3,7` as [1, 2, 3, 7], sorted and distinct; null if malformed, not positive or descending."""
    good = F.regexp_replace(text, r"\s", "").rlike(r"^[0-9]+(-[0-9]+)?(,[0-9]+(-[0-9]+)?)*$")
    parts = F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: F.split(p, "-"))
    ends = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("a"), F.get(p, F.size(p) - 1).cast("int").alias("b")))
    fine = F.forall(ends, lambda e: (e["a"] >= 1) & (e["a"] <= e["b"]))
    return F.when(good & fine, F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], e["b"]))))))


def page_heading_numbers(text: Column) -> Column:
    """Page numbers of `## PDF page N` lines."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*##[ \t]+PDF page[ \t]+([0-9]+)[ \t]*$"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def section(text: Column, heading: str) -> Column:
    """Lines after the last `heading` line up to the next level-two heading; empty without one.

    The first other level-two heading after a match ends the search.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        here, other = strip(line) == heading, line.startswith("## ")
        out = F.when(here, F.array().cast("array<string>")).when(s["inside"] & ~other, F.array_append(s["out"], line)).otherwise(s["out"])
        return F.when(s["over"], s).otherwise(
            F.struct((s["inside"] | here).alias("inside"), (s["inside"] & other & ~here).alias("over"), out.alias("out"))
        )

    return F.aggregate(lines, start, step, lambda s: F.when(s["inside"], F.concat(strip(F.array_join(s["out"], "\n")), F.lit("\n"))).otherwise(""))
