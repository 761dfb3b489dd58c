"""Personal data: a base scan, and information-theoretic sanitisation of terms that give it away.

All in DataFrame expressions. Addresses and numbers are found by pattern. Each value found is a
protected entity, and so is each kind as a whole. Co-occurrence over the corpus tells how much a
term reveals of an entity that it stands beside: their pointwise mutual information as a share of
the entity's information content, which is 1 for a term that never stands without it. Terms above
one threshold are generalised and above another removed, provided that independent texts show it
and that chance doesn't explain it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.binding import let
from evidentia.llm.spans import SPAN, listed, matches, none, outside, part, pieces, replaced, spans
from evidentia.staging import stage

# The kinds of the base scan. Loops that can't succeed by giving back are possessive,
# and an address starts where its run of characters does or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Disclosure at which a term is generalised, and removed.
GENERALISE = 0.8
REMOVE = 0.95
#: Code points around a protected value in which a term stands beside it.
CONTEXT = 150
#: Independent texts in which a term must stand beside an entity; near copies share a sketch and count once.
MIN_SUPPORT = 3
#: Bits by which a term's company must surprise, beyond those that the number of pairs tried explains.
SURPRISE = 7
_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]++"
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_TERM = 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the 14 to 19 digits of a match pass the Luhn sum."""

    def passes(digits: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
            twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
            return total + F.when(i % 2 == 1, twice).otherwise(digit)

        total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
        return F.when(F.length(digits).between(14, 19), total % 10 == 0).otherwise(False)

    return let(_digits(m), passes)


def base_spans(text: Column) -> Column:
    """Base findings of a text that is not null."""
    ask = lambda hint, found: F.when(hint, found).otherwise(none())
    in_range = lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    dialled = lambda m: F.length(_digits(m)).between(10, 15)
    return F.concat(
        ask(text.contains("@"), spans(text, EMAIL, "email", 0)),
        ask(text.rlike(r"[0-9]\.[0-9]"), spans(text, IP, "ip", 1, in_range)),
        ask(text.rlike(CARD), spans(text, CARD, "card", 2, luhn)),
        ask(text.contains("+"), spans(text, PHONE, "phone", 3, dialled)),
    )


def _words(text: Column) -> Column:
    """Runs of letters of a text in lower case, repeats included, with an empty one where it ends in something else."""
    return F.split(F.lower(text), _BETWEEN)


def _terms(text: Column) -> Column:
    """Distinct terms of a text: words of MIN_TERM letters or more."""
    return F.filter(F.array_distinct(_words(text)), lambda t: F.length(t) >= MIN_TERM)


def _sketch(text: Column) -> Column:
    """Two smallest-digest samples of a text's three-word windows; texts that share most windows share them."""

    def least(words: Column) -> Column:
        digests = F.transform(words, lambda w, i: F.md5(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))))
        half = lambda held, at: F.array_min(F.transform(held, lambda h: F.substring(h, at, 16)))
        return let(digests, lambda held: F.struct(half(held, 1).alias("a"), half(held, 17).alias("b")))

    return let(F.split(text, r"[\x20\x09-\x0D]+"), least)


def _context(held: Column, size: Column, s: Column) -> Column:
    """Text around a span, CONTEXT code points on either side, without words cut at its ends."""
    lo, hi = F.greatest(s["start"] - CONTEXT, F.lit(0)), F.least(s["stop"] + CONTEXT, size)
    before = F.when(lo > 0, F.regexp_replace(part(held, lo, s["start"]), f"^{_TERM}", "")).otherwise(part(held, lo, s["start"]))
    after = F.when(hi < size, F.regexp_replace(part(held, s["stop"], hi), f"{_TERM}$", "")).otherwise(part(held, s["stop"], hi))
    return F.concat(before, F.lit(" "), after)


def holders(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text, base, sketch, beside) of rows with base findings.

    beside has for each finding its kind, a hash of its value, and the terms around it.
    """
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)

    def around(t: Column) -> Column:
        one = lambda s: F.struct(
            s["kind"].alias("kind"),
            F.xxhash64(part(t["held"], s["start"], s["stop"])).alias("value"),
            _terms(_context(t["held"], t["size"], s)).alias("terms"),
        )
        return F.transform("base", one)

    measured = F.struct(pieces(F.col("text")).alias("held"), F.length("text").alias("size"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text", "base", _sketch(F.col("text")).alias("sketch"), let(measured, around).alias("beside"))


def _pairs(held: DataFrame, *more: str) -> DataFrame:
    """(text_key, kind, value, term) and `more`: terms around protected entities, an entity being a value (not 0) or a whole kind (value 0)."""
    rows = held.select("text_key", *more, F.explode("beside").alias("s"))
    rows = rows.select("text_key", *more, "s.kind", F.explode(F.array("s.value", F.lit(0))).alias("value"), "s.terms")
    return rows.select("text_key", *more, "kind", "value", F.explode("terms").alias("term"))


def _frequency(rows: DataFrame, terms: DataFrame, name: str) -> DataFrame:
    """In how many different texts of `rows` (text_key, text) each of `terms` stands."""
    found = rows.select("text_key", F.explode(_words(F.col("text"))).alias("term")).join(terms, "term", "left_semi")
    return found.groupBy("term", "text_key").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias(name))


def _revealing(rows: DataFrame, df: str, n_docs: int, tested: int) -> DataFrame:
    """Rows (term, kind, value, n_beside, support, n_entity) with disclosure, that reach both thresholds given `df`."""
    q, p = F.col("n_beside") / F.col(df), F.col("n_entity") / F.lit(float(n_docs))
    share = lambda a, b: F.when(a > 0, a * F.log2(a / b)).otherwise(0.0)
    surprise = F.col("support") / q * (share(q, p) + share(1 - q, 1 - p))
    rows = rows.withColumn("disclosure", 1 - F.log2(q) / F.log2(p)).withColumn("surprise", surprise)
    return rows.where((F.col("disclosure") >= GENERALISE) & (F.col("surprise") >= math.log2(max(tested, 1)) + SURPRISE))


def disclosures(docs: DataFrame, held: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(term, kind, value, disclosure) of terms that reveal an entity: value 0 stands for the kind as a whole.

    Counts are of different texts over the whole corpus. A text counts for a term beside an entity
    if the term stands around one of the entity's findings, and for the term if it stands anywhere.
    """
    texts = _pairs(held, "sketch").groupBy("term", "kind", "value", "text_key").agg(F.first("sketch").alias("sketch"))
    beside = texts.groupBy("term", "kind", "value").agg(
        F.count("*").alias("n_beside"), F.least(F.count_distinct("sketch.a"), F.count_distinct("sketch.b")).alias("support")
    )
    beside = stage(beside.where(F.col("support") >= min_support), "beside")
    tested = beside.count()
    found = held.select("text_key", F.explode("beside").alias("s")).select("text_key", "s.kind", F.explode(F.array("s.value", F.lit(0))).alias("value"))
    entities = found.distinct().groupBy("kind", "value").agg(F.count("*").alias("n_entity"))
    with_text = docs.where("text is not null").select(F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    n_docs = with_text.select("text_key").distinct().count()
    rows = beside.join(stage(entities, "entities"), ["kind", "value"]).where(F.col("n_entity") < n_docs)
    # texts with findings alone bound a term's frequency from below: what fails with that, fails
    fewest = stage(_frequency(held, beside.select("term").distinct(), "df_held"), "df_held")
    rows = stage(_revealing(rows.join(fewest, "term"), "df_held", n_docs, tested).drop("disclosure", "surprise"), "candidates")
    # the empty word is asked for too, so that the corpus is read alike whether or not terms are left
    asked = rows.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    df = stage(_frequency(with_text, stage(asked, "candidate_terms"), "df"), "df")
    return _revealing(rows.join(df, "term"), "df", n_docs, tested).select("term", "kind", "value", "disclosure")


def find(docs: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(doc_id, text_key, base, extra) for every row: base spans, and spans of terms to generalise or remove.

    A term that reveals an entity goes from every text that has it around one of the entity's
    findings, wherever in that text it stands outside base spans. A null text is empty. Rows
    alike in doc_id and text get the same spans; texts are told apart by a 64-bit hash.
    """
    held = stage(holders(docs), "holders")
    risky = stage(disclosures(docs, held, min_support), "risky")
    named = _pairs(held).join(risky, ["term", "kind", "value"]).groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure"))
    removed = lambda yes: F.collect_list(F.when((F.col("disclosure") >= REMOVE) == yes, F.col("term")))
    named = stage(named.groupBy("text_key").agg(removed(True).alias("removed"), removed(False).alias("generalised")), "named")

    def extra(text: Column, base: Column) -> Column:
        def told(words: Column) -> Column:
            lower = F.transform(words, lambda w: w.withField("match", F.lower(w["match"])))
            of = lambda names, kind: F.transform(
                F.filter(lower, lambda w: F.array_contains(names, w["match"])),
                lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), F.lit(kind).alias("kind"), F.lit(4).alias("rank")),
            )
            return outside(F.concat(of(F.col("removed"), "term_removed"), of(F.col("generalised"), "term_generalised")), base)

        return let(matches(text, _TERM), told)

    rows = held.select("doc_id", "text_key", "text", "base").join(named, "text_key", "left")
    rows = rows.select("doc_id", "text_key", "base", F.when(F.col("removed").isNull(), none()).otherwise(extra(F.col("text"), F.col("base"))).alias("extra"))
    both = stage(rows.groupBy("doc_id", "text_key").agg(F.first("base").alias("base"), F.first("extra").alias("extra")), "found")
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    same = rows.doc_id.eqNullSafe(both.doc_id) & (rows.text_key == both.text_key)
    return rows.join(both, same, "left").select(
        rows.doc_id, rows.text_key, F.coalesce("base", none()).alias("base"), F.coalesce("extra", none()).cast(SPAN).alias("extra")
    )


def scan(docs: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """A row for every row of `docs`: counts and digest of the base spans, all spans listed.

    A null text is empty; a null doc_id stays null; repeated rows each get a row; columns but
    doc_id and text aren't read, whatever their names.
    """
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find(docs, min_support).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "extra")).alias("spans"),
    )


def sanitise(docs: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """`docs` with protected values and removed terms taken out and generalised terms replaced by a class word.

    A row for each row, in the same columns; a null text stays null.
    """
    found = find(docs, min_support).where((F.size("base") > 0) | (F.size("extra") > 0))
    found = found.dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("id"), "text_key", F.concat("base", "extra").alias("gone")
    )
    own_key = F.xxhash64(F.col("text").cast("string")).alias("own_key")
    rows = docs.select(F.col("doc_id").alias("own_id"), own_key, F.struct("*").alias("row"))
    same = rows.own_id.eqNullSafe(found.id) & (rows.own_key == found.text_key)
    rows = rows.join(found, same, "left").select("row", "gone")

    def mark(kind: Column) -> Column:
        named = F.concat(F.lit("["), F.upper(kind), F.lit("]"))
        return F.when(kind == "term_removed", "").when(kind == "term_generalised", "[TERM]").otherwise(named)

    clean = replaced(F.col("row.text"), F.col("gone"), mark)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(clean)
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
