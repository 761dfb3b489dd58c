"""One cycle of incremental processing: a new stable version against the last, down to queued work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import alignment, drafts, headings


def candidate_pages(aligned: DataFrame, items: DataFrame) -> DataFrame:
    """(document, current_page): changed pages, and those that end an item which touches one."""
    revised = alignment.revisions(items, aligned).where("current_page is not null").select("document", "current_page")
    return alignment.changed_pages(aligned).unionByName(revised).distinct()


def cycle(previous: DataFrame | None, current: DataFrame, done: DataFrame, items: DataFrame, states: DataFrame, queue: DataFrame, subject: str, source_sha: str) -> tuple[str, DataFrame]:
    """(reason, work): what to queue for a new version.

    `previous` and `current` are identified pages, `done` (document, page_number) carry a completion
    stamp, `items` (document, item, pages) were completed before. Without a previous version the
    cycle sets a baseline; without relevant changes it does nothing.
    """
    nothing = done.sparkSession.createDataFrame([], "subject string, question string, source_sha256 string, done_page int, start_page int")
    if previous is None:
        return "INITIAL_BASELINE_ESTABLISHED", nothing
    candidates = candidate_pages(alignment.align(previous, current), items)
    marked = candidates.join(done.withColumnRenamed("page_number", "current_page"), ["document", "current_page"], "left_semi")
    if not marked.limit(1).count():
        return "NO_RELEVANT_PAGE_CHANGES", nothing
    flagged = current.join(marked.withColumnRenamed("current_page", "page_number").withColumn("done", F.lit(True)), ["document", "page_number"], "left")
    rows = flagged.select("document", "page_number", F.col("native_text").alias("text"), F.coalesce("done", F.lit(False)).alias("done"))
    resolved = headings.latest_by_question(headings.resolve(rows)).select(
        F.lit(subject).alias("subject"), "question", F.lit(source_sha).alias("source_sha256"), "done_page", "start_page"
    )
    return "PROCESSED_STABLE_UPDATE", drafts.completions(resolved, states, queue)


def startup_reason(has_state: bool, has_index: bool, kept_sha: str | None, current_sha: str, stable: bool) -> str:
    """Why a restarted watch begins as it does."""
    if not stable:
        return "SOURCE_CHANGED_AFTER_STABILITY_CHECK"
    if not has_state:
        return "INITIAL_BASELINE_ESTABLISHED"
    if kept_sha == current_sha:
        return "PERSISTED_BASELINE_UNCHANGED" if has_index else "PERSISTED_BASELINE_REESTABLISHED"
    return "PROCESSED_STABLE_UPDATE" if has_index else "PERSISTED_BASELINE_REESTABLISHED"
