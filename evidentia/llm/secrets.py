"""Secret scans with multipart credential linking, in DataFrame expressions only.

Base findings are keyword assignments, access key ids and long hexadecimal strings. Weak
candidates (login names and addresses, opaque mixed tokens, service addresses) prove little
alone. Parts lie in one scope if at most NEAR code points part them, or at most BLOCK within
one block of lines, that is without a blank line between. An interval join finds complementary
parts: an identifier and a secret, or a secret and an endpoint; a weak candidate is reported
only beside its complement. The join is a sweep over parts in order of place, which asks the
complement that reaches farthest before a part and the one that begins first after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.binding import let
from evidentia.llm.spans import listed, matches, none, replaced, running, spans

# The kinds of the base scan.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
)
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")

#: Code points between parts of one scope: anywhere, and inside a block of lines.
NEAR = 400
BLOCK = 2_000
_BLANK = r"\n[\x20\t\r]*\n"
#: Weak parts: a name or address at sign-in, an opaque token of both letters and digits, an address to sign in at.
IDENTIFIER = (
    r"(?i)\b(?:user(?:name)?|login|client_?id|account(?:_?id)?)[\"']?\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9@._-]{3,}+"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IDENTIFIER_HINT = r"(?i)@|\b(?:user|login|client|account)"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[a-z+/_=-]*+[A-Z0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x00-\x20\"'<>]++"


def _when(hint: Column, found: Column) -> Column:
    return F.when(hint, found).otherwise(none())


def base_spans(text: Column) -> Column:
    """Base findings of a text that is not null."""
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return F.concat(
        _when(text.rlike(ASSIGN_HINT), spans(text, ASSIGN, "assign", 0, long_enough)),
        _when(text.contains("AKIA"), spans(text, ACCESS, "access", 1, lambda m: F.length(m) >= 20)),
        _when(text.rlike(HEX), spans(text, HEX, "hex", 2)),
    )


def weak_spans(text: Column) -> Column:
    """Candidates that count only beside a complementary part."""
    return F.concat(
        _when(text.rlike(IDENTIFIER_HINT), spans(text, IDENTIFIER, "linked_id", 3)),
        _when(text.rlike(OPAQUE), spans(text, OPAQUE, "linked_secret", 4)),
        _when(text.contains("://"), spans(text, ENDPOINT, "linked_endpoint", 5)),
    )


def _blocked(text: Column, parts: Column) -> Column:
    """`parts` by place, each with the number of its block of lines, from 1."""
    breaks = F.transform(matches(text, _BLANK), lambda m: F.struct(m["start"].alias("start"), F.lit(-1).alias("rank"), m["stop"].alias("stop"), F.lit("").alias("kind")))
    rows = F.concat(breaks, F.transform(parts, lambda s: F.struct(s["start"], s["rank"], s["stop"], s["kind"])))

    def counted(places: Column) -> Column:
        before = running(F.transform(places, lambda s: (s["rank"] < 0).cast("int")))
        told = lambda n: F.transform(places, lambda s, i: s.withField("block", F.get(n, i) + 1))
        return F.filter(let(before, told), lambda s: s["rank"] >= 0)

    return let(F.array_sort(rows), counted)


def linked(text: Column, base: Column, weak: Column) -> Column:
    """The weak spans that have a complementary part in their scope, and lie outside base spans."""
    secret = lambda s: s["kind"].isin("assign", "hex", "linked_secret")
    found = lambda s: s["rank"] < len(KINDS)

    def swept(held: Column) -> Column:
        parts, size, blocks = held["parts"], held["size"], held["blocks"]
        # how far back the parts before reach, and, read backwards, those after
        back = lambda test, value: running(F.transform(parts, lambda s: F.when(test(s), value(s)).otherwise(0)), F.greatest)
        ahead = lambda test, value: F.reverse(
            running(F.reverse(F.transform(parts, lambda s: F.when(test(s), value(s)).otherwise(0))), F.greatest)
        )
        sides = lambda test: F.struct(
            back(test, lambda s: s["stop"]).alias("stop"),
            back(test, lambda s: s["block"]).alias("last"),
            ahead(test, lambda s: size - s["start"]).alias("start"),
            ahead(test, lambda s: blocks - s["block"]).alias("next"),
        )

        def near(s: Column, i: Column, side: Column) -> Column:
            last, following = F.get(side["last"], i), blocks - F.get(side["next"], i)
            far = lambda block: F.when(block == s["block"], BLOCK).otherwise(NEAR)
            before = (last > 0) & (s["start"] - F.get(side["stop"], i) <= far(last))
            after = (F.get(side["next"], i) > 0) & (size - F.get(side["start"], i) - s["stop"] <= far(following))
            return before | after

        def overlaps(s: Column, i: Column, side: Column) -> Column:
            first = F.get(side["start"], i)
            return (F.get(side["stop"], i) > s["start"]) | ((first > 0) & (size - first < s["stop"]))

        def chosen(x: Column) -> Column:
            beside = lambda s, i: F.when(secret(s), near(s, i, x["other"])).otherwise(near(s, i, x["secret"]))
            return F.filter(parts, lambda s, i: ~found(s) & beside(s, i) & ~overlaps(s, i, x["found"]))

        classes = F.struct(sides(secret).alias("secret"), sides(lambda s: ~secret(s)).alias("other"), sides(found).alias("found"))
        return F.transform(
            let(classes, chosen),
            lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["rank"].alias("rank")),
        )

    alone = F.size(base) + F.size(weak) < 2
    last = lambda parts: F.array_max(F.transform(parts, lambda s: s["block"]))
    measured = lambda parts: F.struct(parts.alias("parts"), F.length(text).alias("size"), (last(parts) + 1).alias("blocks"))
    whole = let(_blocked(text, F.concat(base, weak)), lambda parts: let(measured(parts), swept))
    return F.when((F.size(weak) == 0) | alone, none()).otherwise(whole)


def _spans(text: Column) -> Column:
    """Struct of base and linked spans of a text that is not null."""
    both = let(text, lambda t: F.struct(base_spans(t).alias("base"), weak_spans(t).alias("weak")))
    return let(both, lambda x: F.struct(x["base"].alias("base"), linked(text, x["base"], x["weak"]).alias("extra")))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, extra) for every row: base and linked spans. A null text is empty."""
    found = let(F.coalesce(F.col("text").cast("string"), F.lit("")), _spans)
    return docs.select("doc_id", "text", found.alias("found")).select("doc_id", "text", "found.base", "found.extra")


def secret_scan(docs: DataFrame) -> DataFrame:
    """A row for every row of `docs`: counts and digest of the base spans, all spans listed.

    A null text is empty and has no spans; a null doc_id stays null; repeated rows each get a
    row; columns but doc_id and text aren't read, whatever their names.
    """
    found = find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "extra")).alias("spans"),
    )


def redact(docs: DataFrame, size: str | None = "n_chars") -> DataFrame:
    """`docs` with every secret in text replaced by its kind in brackets; `size` names a length to keep right.

    A row for each row, in the same columns; a null text stays null, and `size` with it.
    """
    mark = lambda kind: F.concat(F.lit("["), F.upper(kind), F.lit("]"))
    clean = lambda t: let(_spans(t), lambda x: replaced(t, F.concat(x["base"], x["extra"]), mark))
    columns = docs.columns
    rows = docs.withColumn("text", F.when(F.col("text").isNotNull(), let(F.col("text").cast("string"), clean)))
    if size in columns:
        rows = rows.withColumn(size, F.length("text").cast(docs.schema[size].dataType))
    return rows.select(*columns)
