"""Heading assessment and the nearest preceding accepted heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import text

MAX_BACKTRACK = 16
# Headings, contents pages, auxiliary roles and cues of a problem statement.
HEADER = r"第\s*([0-9]{1,3})\s*問"
HEADER_LIKE = r"第\s*[^\s問]{0,8}\s*問"
TITLE = r"第\s*([0-9]{1,3})\s*問(?:\s*\S{1,8})?"
CONTENTS = "目次"
AUXILIARY = "指針|総括|MEMO|メモ|答案例|答案"
CUES = "問題文|設問|次の|以下|罪責|論ぜ|答えよ"


def assess(body: Column) -> Column:
    """struct(decision, question, reasons) of a page's header text (already NFKC); null without anything like a heading."""
    lines = F.filter(F.transform(F.split(body, r"\r\n?|\n"), text.strip), lambda x: x != "")
    titles = F.filter(lines, lambda x: x.rlike(f"(?U)^{TITLE}$"))
    numbers = F.array_distinct(F.transform(titles, lambda x: F.regexp_extract(x, f"(?U){HEADER}", 1)))
    malformed = F.exists(lines, lambda x: x.rlike(f"(?U)^{HEADER_LIKE}$"))
    question = F.get(numbers, F.lit(0))
    cue, auxiliary = body.rlike(CUES), body.rlike(AUXILIARY)
    part = F.concat(F.lit(r"(?U)(?<!\d)"), question, F.lit(r"\s*[-－]\s*1(?!\d)"))
    booklet = F.regexp_count(body, part) > 0

    def answer(decision: str, reasons: Column | str, number: Column | None = None) -> Column:
        reasons = F.array(F.lit(reasons)) if isinstance(reasons, str) else reasons
        number = F.lit(None).cast("string") if number is None else number
        return F.struct(F.lit(decision).alias("decision"), number.alias("question"), reasons.alias("reasons"))

    first = F.nullif(F.regexp_extract(body, f"(?U){HEADER}", 1), F.lit(""))
    accepted = F.array_compact(
        F.array(F.lit("exact_question_heading"), F.when(booklet, "booklet_part_1"), F.when(cue, "problem_or_question_text"))
    )
    return (
        F.when(~body.rlike(f"(?U){HEADER_LIKE}"), None)
        .when(body.contains(CONTENTS), answer("REJECT_TABLE_OF_CONTENTS", "table_of_contents"))
        .when((F.size(titles) == 0) & malformed, answer("UNRESOLVED_AMBIGUOUS_HEADING", "ambiguous_or_malformed_heading"))
        .when(F.size(titles) == 0, answer("REJECT_CROSS_REFERENCE", "heading_is_not_a_page_title", first))
        .when(F.size(numbers) != 1, answer("UNRESOLVED_AMBIGUOUS_HEADING", "ambiguous_or_malformed_heading"))
        .when(auxiliary & ~cue, answer("REJECT_AUXILIARY_HEADING", "auxiliary_heading_without_problem_text", question))
        .otherwise(answer("ACCEPT_PROBLEM_START", accepted, question))
    )


def resolve(pages: DataFrame, max_backtrack: int = MAX_BACKTRACK) -> DataFrame:
    """Done pages (document, page_number, text, done) with the question of the nearest heading at or before them.

    At most `max_backtrack` pages back; the walk ends at the first accepted heading, and ends
    unresolved at the first ambiguous one. Rejected headings are passed over. Pages are dealt out
    before they are assessed, as the walk needs them to be, so that few input files don't make few tasks.
    """
    seen = pages.repartition("document").withColumn("h", assess(text.nfkc(F.coalesce("text", F.lit("")))))
    stops = F.col("h.decision").isin("ACCEPT_PROBLEM_START", "UNRESOLVED_AMBIGUOUS_HEADING")
    frame = W.partitionBy("document").orderBy("page_number").rangeBetween(-max_backtrack, 0)
    last = F.last(F.when(stops, F.struct("page_number", "h.decision", "h.question")), ignorenulls=True).over(frame)
    rows = seen.withColumn("at", last).where("done")
    found = F.coalesce(F.col("at.decision") == "ACCEPT_PROBLEM_START", F.lit(False))
    return rows.select(
        "document",
        F.col("page_number").alias("done_page"),
        found.alias("resolved"),
        F.when(found, F.col("at.question")).alias("question"),
        F.when(found, F.col("at.page_number")).alias("start_page"),
        F.when(found, F.lit("RESOLVED")).when(F.col("at").isNotNull(), "UNRESOLVED_AMBIGUOUS_HEADING").otherwise("NO_HEADING_IN_RANGE").alias("reason"),
    )


def nearest_preceding(rows: DataFrame, by: str, order: str, marker: Column, value: str, back: int = MAX_BACKTRACK) -> DataFrame:
    """As-of backward: the last `value` where `marker` holds among a row and its `back` predecessors in value of `order`."""
    frame = W.partitionBy(by).orderBy(order).rangeBetween(-back, 0)
    return rows.withColumn("nearest", F.last(F.when(marker, F.col(value)), ignorenulls=True).over(frame))


def sections(notes: DataFrame) -> DataFrame:
    """(note, page_number, section): text from each `## PDF page N` line to the next such line."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n(?=## PDF page [0-9]+[ \t]*(?:\n|$))")
    rows = notes.select("note", F.explode(parts).alias("section")).where(F.col("section").startswith("## PDF page "))
    return rows.select("note", F.regexp_extract("section", "^## PDF page ([0-9]+)", 1).cast("int").alias("page_number"), "section")


def latest_by_question(resolved: DataFrame) -> DataFrame:
    """The resolution with the highest page for each question."""
    nth = F.row_number().over(W.partitionBy("document", "question").orderBy(F.desc("done_page")))
    return resolved.where("resolved").withColumn("nth", nth).where("nth = 1").drop("nth")
