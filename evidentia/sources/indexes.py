"""Page indexes kept by source: read-through cache, strict load, and the latest earlier version of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _partition(root: str, source_sha: str) -> str:
    return f"{root}/source_sha256={source_sha}"


def load_index(spark: SparkSession, root: str, source_sha: str) -> DataFrame:
    """The index of one source; an error if there is none or it names another source."""
    path = _partition(root, source_sha)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.parquet(path)
    if rows.where(F.col("embedded_sha256") != source_sha).limit(1).count():
        raise ValueError(f"{path} holds the index of another source")
    return rows


def ensure_index(spark: SparkSession, root: str, source_sha: str, filename: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The kept index if source and file name agree, else a new one in its place; and whether it was kept."""
    path = _partition(root, source_sha)
    if _exists(spark, path):
        kept = spark.read.parquet(path)
        if {"embedded_sha256", "filename"} <= set(kept.columns):
            other = (F.col("embedded_sha256") != source_sha) | (F.col("filename") != filename)
            if not kept.where(other).limit(1).count() and kept.limit(1).count():
                return kept, True
    rows = build().withColumns({"embedded_sha256": F.lit(source_sha), "filename": F.lit(filename), "generated_at": F.current_timestamp()})
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


def previous_index(indexes: DataFrame, filename: str, source_sha: str) -> DataFrame:
    """Rows of the newest index of the same file name and another source; none if there is none."""
    others = indexes.where((F.col("filename") == filename) & (F.col("embedded_sha256") != source_sha))
    newest = others.agg(F.max_by("embedded_sha256", F.struct("generated_at", "embedded_sha256")).alias("newest"))
    return others.join(F.broadcast(newest), F.col("embedded_sha256") == F.col("newest")).drop("newest")  # one row


def resolved_pages(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(item, page_number, issue) for wanted pages (item, stable_page_id, page_number or null) of an index.

    A given page number must exist with its id; an id alone must stand for exactly one page.
    """
    held = index.groupBy("stable_page_id").agg(F.array_sort(F.collect_set("page_number")).alias("at"))
    rows = wanted.join(held, "stable_page_id", "left")
    given = F.col("page_number").isNotNull()
    issue = (
        F.when(F.col("at").isNull(), "UNKNOWN_PAGE_ID")
        .when(given & ~F.array_contains("at", F.col("page_number")), "PAGE_DOES_NOT_MATCH_ID")
        .when(~given & (F.size("at") > 1), "AMBIGUOUS_PAGE_ID")
    )
    page = F.when(issue.isNull(), F.coalesce("page_number", F.get("at", F.lit(0))))
    return rows.select("item", page.alias("page_number"), issue.alias("issue"))


def manifest(manifests: DataFrame, **key: str) -> DataFrame:
    """The one manifest whose columns equal all of `key`; an error if there are none or several."""
    found = manifests
    for name, value in key.items():
        found = found.where(F.col(name) == value)
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if n == 0 else 'more than one'} manifest for {key}")
    return found


def effective_pages(requests: DataFrame) -> DataFrame:
    """(…, pages) with all pages 1 to page_count where none are requested."""
    everything = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), "page_count")).otherwise(F.array().cast("array<int>"))
    return requests.withColumn("pages", F.array_sort(F.array_distinct(F.coalesce("requested_pages", everything))))
