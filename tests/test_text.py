"""Text rules against plain Python versions."""

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidentia.functions import hashing, text


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expression).first()[0]


def suspicious(c):
    if c.isspace():
        return False
    if c == "\ufffd" or 0xE000 <= ord(c) <= 0xF8FF or unicodedata.category(c) == "Cc":
        return True
    if unicodedata.category(c)[0] not in "LN":
        return False
    if any(a <= c <= b for a, b in ("々〇", "〻〻", "\u3040\u30ff", "\u3400\u9fff", "\uf900\ufaff")) or c == "〆":
        return False
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isascii() and folded.isalnum():
        return False
    inner = folded.removeprefix("(").removesuffix(")")
    return not (inner.isascii() and inner.isdigit())


SAMPLES = ["これは日本語の文章である。", "abc éü \ufffd\ue000 ß", "①⑴ⅣＡ９²", "a\x07b\u3000c\x1cd\xa0e", "", "   ", "Русский текст и ελληνικά", "rank stock memo xx Yy zz9"]


@pytest.mark.parametrize("body", SAMPLES)
def test_counts(spark, body):
    seen = [c for c in body if not c.isspace()]
    bad = sum(map(suspicious, body))
    assert one(spark, text.visible_count(F.col("t")), t=body) == len(seen)
    assert one(spark, text.suspicious_count(F.col("t")), t=body) == bad
    assert one(spark, text.useful_count(F.col("t")), t=body) == sum(unicodedata.category(c) != "Cc" for c in seen)
    printable = sum(unicodedata.category(c)[0] != "C" for c in seen)
    wanted = max(0.0, min(1.0, printable / len(seen) - min(0.85, 3 * bad / len(seen)))) if seen else 0.0
    assert one(spark, text.quality(F.col("t")), t=body) == pytest.approx(wanted, abs=1e-4)


def test_every_code_point_in_class(spark):
    codes = [c for c in range(0x20, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, t string").where(text.suspicious_count(F.col("t")) > 0)
    found = {r.c for r in rows.collect()}
    wanted = {c for c in codes if suspicious(chr(c))}
    assert found <= wanted and len(wanted - found) < 1500  # Java's tables lack the newest letters


def test_noise_tokens(spark):
    assert one(spark, text.noise_count(F.col("t")), t="ab CD Efg rank xx1 memo q") == 2
    assert one(spark, text.is_accurate(F.col("t")), t="第1問") is True
    assert one(spark, text.is_accurate(F.col("t")), t="") is False


@pytest.mark.parametrize(
    ("native", "seen", "wanted"),
    [
        ("abc", "abc", "exact"),
        ("ab", "xabx", "native_contained_in_ocr"),
        ("xabx", "ab", "ocr_contained_in_native"),
        ("a b", "ab", "exact_ignoring_whitespace"),
        ("a b c", "xabcx", "native_contained_in_ocr_ignoring_whitespace"),
        ("xa bcx", "a b c", "ocr_contained_in_native_ignoring_whitespace"),
        ("a", "ab", None),
        ("abc", "xyz", None),
    ],
)
def test_agreement(spark, native, seen, wanted):
    assert one(spark, text.agreement(F.col("a"), F.col("b")), a=native, b=seen) == wanted


def test_protection_and_support(spark):
    protected = text.is_protected(F.col("a"), F.col("b"))
    assert one(spark, protected, a="本文", b="第１条") and one(spark, protected, a="x", b="①") and not one(spark, protected, a="条件", b="甲")
    support = text.page_support(F.col("a"), F.col("b"))
    assert one(spark, support, a="a b", b="x ab y") is True
    assert one(spark, support, a="zz", b="x ab y") is False
    assert one(spark, support, a="a", b=None) is None and one(spark, support, a=" ", b="x") is False


def test_unique_range_counts_overlaps(spark):
    found = text.unique_range(F.col("a"), F.col("b"))
    assert tuple(one(spark, found, a="xaby", b="ab")) == (1, 3)
    assert one(spark, found, a="aaa", b="aa") is None and one(spark, found, a="x", b="") is None


def test_line_cursor_skips_misses(spark):
    rows = spark.createDataFrame([("ab cd ab ef", ["ab", "zz", "ab", "cd", "ef"])], "t string, l array<string>")
    found = rows.select(text.line_ranges(F.col("t"), F.col("l")).alias("r")).first().r
    assert [(r.line, r.start, r.stop) for r in found] == [("ab", 0, 2), ("ab", 6, 8), ("ef", 9, 11)]


def test_trim_and_replace(spark):
    trimmed = text.trim_candidate(F.col("n"), F.col("o"), F.col("p"))
    assert one(spark, trimmed, n="Χき", o="前書き後", p="文前Χき後文") == "書き"
    assert one(spark, trimmed, n="ab", o="xaby", p="ab ab") == "xaby"
    rows = spark.createDataFrame([("one two three two", [("one", "1"), ("two", "2"), (" three ", "3")])], "t string, e array<struct<target:string,replacement:string>>")
    assert rows.select(text.replace_once(F.col("t"), F.col("e"))).first()[0] == "1 two3two"


def test_sequence_ratio_is_difflib(spark):
    a, b = "abcd" * 80, "bcde" * 75
    for x, y in ((a, b), (b, a), ("", "")):
        assert one(spark, text.sequence_ratio(F.col("a"), F.col("b")), a=x, b=y) == difflib.SequenceMatcher(None, x, y).ratio()


@pytest.mark.parametrize(("body", "wanted"), [("第007条", "7"), ("12", "12"), ("000", "0"), ("第一条", None), ("", None)])
def test_articles(spark, body, wanted):
    assert one(spark, text.article_number(F.col("t")), t=body) == wanted


def test_names_and_paths(spark):
    name = text.safe_component(F.col("t"))
    assert one(spark, name, t=" a/b:c. ") == "a-b-c" and one(spark, name, t="CON") == "_CON" and one(spark, name, t="..") == "untitled"
    assert len(one(spark, name, t="x" * 200)) == 80
    good = hashing.is_relative(F.col("t"))
    assert [one(spark, good, t=p) for p in ("a/b.md", "a..b/c", "../x", "a/../b", "/x", "C:\\x", "", None)] == [True, True] + [False] * 6
    assert one(spark, hashing.relative_to(F.col("a"), F.col("b")), a="/r/x\\y.png", b="/r") == "x/y.png"
    assert one(spark, hashing.has_offset(F.col("t")), t="2025-01-02T03:04:05+09:00") is True
    assert one(spark, hashing.has_offset(F.col("t")), t="2025-01-02T03:04:05") is False


def test_sections_and_slices(spark):
    note = "# t\n## X\nold\n## X\nnew\nmore\n## Y\n## X\nlate"
    assert one(spark, text.section(F.col("t"), "## X"), t=note) == "new\nmore\n"
    assert one(spark, text.section(F.col("t"), "## Z"), t=note) == ""
    assert one(spark, text.slices(F.col("t"), 2), t="abcde") == ["ab", "cd", "e"] and one(spark, text.slices(F.col("t")), t="") == []
    assert one(spark, text.page_heading_numbers(F.col("t")), t="## PDF page 2\nx\n## PDF page 1\n## PDF page 2 x") == [1, 2]


def test_payload_hash_keeps_nulls_and_order(spark):
    rows = spark.createDataFrame([("x", None)], "b string, a string")
    found = rows.select(hashing.payload_hash(b=F.col("b"), a=F.col("a")), hashing.payload_hash(a=F.col("a"), b=F.col("b")), hashing.text_hash(F.lit('{"a":null,"b":"x"}'))).first()
    assert found[0] == found[1] == found[2]
