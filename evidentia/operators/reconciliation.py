"""Reconciling native text with independently recognised text, and the repairs that are safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import geometry as geo
from evidentia.functions import text

MATCH_OVERLAP = 0.2
# Gates of an automatic repair.
LENGTH_RATIO = (0.55, 1.55)
MIN_SIMILARITY = 0.68
ALONE_SIMILARITY = 0.88
MIN_CONFIDENCE = 0.80


def native_box(kind: Column, native_bbox: Column, bbox: Column, padding: Column) -> Column:
    """Where the native text of a target lies; null for targets without one."""
    return F.coalesce(native_bbox, F.when(kind == "suspect_native_text", geo.shrink(bbox, F.coalesce(padding, F.lit(0.0)))))


def best_line(lines: Column, native: Column) -> Column:
    """The line struct(text, confidence, pdf_bbox) that overlaps a native box most, the first of equals, with its overlap."""
    ranked = F.transform(
        F.filter(lines, lambda x: x["pdf_bbox"].isNotNull() & x["text"].isNotNull()),
        lambda x, i: F.struct(geo.overlap_ratio(native, x["pdf_bbox"]).alias("overlap"), (-i).alias("order"), x["text"].alias("text"), x["confidence"].alias("confidence")),
    )
    return F.array_max(ranked)


def numbered(evidence: DataFrame) -> DataFrame:
    """Evidence rows with record_id: full page first, then regions counted from 1."""
    order = W.partitionBy("document", "page_number").orderBy((F.col("kind") != "full_page"), "ordinal")
    return evidence.withColumn("record_id", F.format_string("p%04d-ocr-%03d", "page_number", F.row_number().over(order)))


def reconcile(evidence: DataFrame, similarity: bool = True) -> DataFrame:
    """Each evidence row with ocr text, agreement, similarity, status, reason and selected source.

    Evidence has record_id, document, page_number, kind, status, native_candidate, bbox, native_bbox,
    padding, text, confidence and lines.
    """
    box = native_box(F.col("kind"), F.col("native_bbox"), F.col("bbox"), F.col("padding"))
    rows = evidence.withColumn("box", box).withColumn("best", best_line(F.col("lines"), F.col("box")))
    lined = F.col("box").isNotNull() & F.col("lines").isNotNull()
    rows = rows.withColumns(
        {
            "ocr_text": F.when(lined, F.col("best.text")).otherwise(F.col("text")),
            "ocr_confidence": F.when(lined, F.col("best.confidence")).otherwise(F.col("confidence")),
            "coordinate_match": F.when(lined, F.coalesce(F.col("best.overlap") >= MATCH_OVERLAP, F.lit(False))),
        }
    )
    rows = rows.withColumns({"n": text.comparable(F.col("native_candidate")), "o": text.comparable(F.col("ocr_text"))})
    both = (F.col("n") != "") & (F.col("o") != "")
    ratio = text.sequence_ratio(F.col("n"), F.col("o")) if similarity else F.lit(None).cast("double")
    rows = rows.withColumns({"agreement": F.when(both, text.agreement(F.col("n"), F.col("o"))), "similarity": F.when(both, F.round(ratio, 6))})
    return rows.withColumn("d", status()).select(*[c for c in rows.columns if c not in ("box", "best", "n", "o")], F.col("d.status").alias("review_status"), "d.reason", "d.selected_source")


def status() -> Column:
    """struct(status, reason, selected_source) from the columns status, kind, n, agreement and coordinate_match."""

    def answer(level: str, reason: Column | str, source: str | None = None) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(level).alias("status"), reason.alias("reason"), F.lit(source).cast("string").alias("selected_source"))

    kind = F.col("kind")
    verified = (kind == "suspect_native_text") & (F.col("n") != "") & F.col("agreement").isNotNull() & F.coalesce("coordinate_match", F.lit(False))
    return (
        F.when(F.coalesce(F.col("status") != "completed", F.lit(True)), answer("UNRESOLVED", F.coalesce("status", F.lit("unknown"))))
        .when(verified, answer("AUTO_VERIFIED", F.concat(F.lit("normalized_"), "agreement", F.lit("_with_coordinate_overlap")), "native"))
        .when(kind == "suspect_native_text", answer("NEEDS_REVIEW", "suspicious_native_ocr_mismatch"))
        .when(kind == "image_region", answer("NEEDS_REVIEW", "ocr_only_image_region", "ocr_supplement"))
        .when(kind == "full_page", answer("NEEDS_REVIEW", "full_page_ocr_on_insufficient_or_low_quality_native"))
        .otherwise(answer("NEEDS_REVIEW", "unclassified_ocr_evidence"))
    )


def mean_confidence(records: DataFrame) -> DataFrame:
    """Records with mean_confidence over the lines that state one, null without any, and n_lines, how many do."""
    stated = F.filter(F.transform("lines", lambda x: x["confidence"]), lambda c: c.isNotNull())
    total = F.aggregate("stated", F.lit(0.0), lambda s, c: s + c.cast("double"))
    rows = records.withColumn("stated", stated).withColumn("n_lines", F.when(F.col("stated").isNull(), 0).otherwise(F.size("stated")))
    return rows.withColumn("mean_confidence", F.when(F.col("n_lines") > 0, total / F.col("n_lines"))).drop("stated")


def supplements(records: DataFrame) -> DataFrame:
    """Records whose recognised text adds to a page."""
    return records.where((F.coalesce("ocr_text", F.lit("")) != "") & F.col("kind").isin("image_region", "full_page"))


def status_counts(records: DataFrame) -> DataFrame:
    """Count for every status, zero for those that don't occur."""
    known = records.sparkSession.createDataFrame([(s,) for s in ("AUTO_VERIFIED", "NEEDS_REVIEW", "UNRESOLVED")], "review_status string")
    counted = records.groupBy("review_status").agg(F.count("*").alias("n"))
    return F.broadcast(known).join(counted, "review_status", "left").select("review_status", F.coalesce("n", F.lit(0)).alias("n"))


def page_ocr(records: DataFrame) -> DataFrame:
    """(document, page_number, page_ocr): the last full-page text of each page."""
    full = records.where((F.col("kind") == "full_page") & F.col("ocr_text").isNotNull())
    return full.groupBy("document", "page_number").agg(F.max_by("ocr_text", "record_id").alias("page_ocr"))


def decisions(records: DataFrame, pages: DataFrame) -> DataFrame:
    """A repair decision for every surgical record; pages are (document, page_number, native_text, trust).

    The records of a page are gathered before they meet its texts, which are sent to Python and normalised once
    a page, not once a record.
    """
    on = ["document", "page_number"]
    record = F.struct("record_id", F.coalesce("native_candidate", F.lit("")).alias("native"), F.coalesce("ocr_text", F.lit("")).alias("seen"), "coordinate_match", "ocr_confidence")
    gathered = records.where(F.col("kind") == "suspect_native_text").groupBy(*on).agg(F.collect_list(record).alias("records"))
    rows = gathered.join(pages.select(*on, "native_text", "trust"), on).join(page_ocr(records), on, "left")
    found = text.page_repairs(F.col("records.native"), F.col("records.seen"), F.col("native_text"), F.col("page_ocr"))
    rows = rows.select(*on, "trust", "records", found.alias("found")).select(*on, "trust", F.explode(F.arrays_zip("records", "found")).alias("r"))
    rows = rows.select(*on, "trust", "r.records.*", "r.found.*")
    noise = lambda c: text.suspicious_count(F.col(c)) + text.noise_count(F.col(c))
    rows = rows.withColumns(
        {
            "noise_before": noise("native"),
            "noise_after": noise("candidate"),
            "protected": text.is_protected(F.col("native"), F.col("candidate")),
        }
    )
    return rows.withColumn("d", verdict()).select(
        *on, "record_id", "native", "seen", "candidate", F.round("similarity", 6).alias("similarity"), "coordinate_match", "support", "protected", "ocr_confidence", F.col("d.status").alias("status"), "d.reason"
    )


def verdict() -> Column:
    """struct(status, reason) of one repair. A null corroboration is not a failed one."""
    sure = F.coalesce(F.col("ocr_confidence") >= MIN_CONFIDENCE, F.lit(False))
    matched = F.coalesce("coordinate_match", F.lit(False))
    less = F.col("noise_after") < F.col("noise_before")
    supported = F.coalesce("support", F.lit(False))
    alone = F.col("support").isNull() & (F.col("similarity") >= ALONE_SIMILARITY)
    backed = F.when(F.col("trust") == "low", supported).otherwise(supported | alone)
    sound = matched & F.col("length_ratio").between(*LENGTH_RATIO) & (F.col("similarity") >= MIN_SIMILARITY) & less & sure
    against = F.array_compact(
        F.array(
            F.when(~matched, "coordinate_mismatch"),
            F.when(~less, "ocr_does_not_reduce_suspicious_content"),
            F.when(F.col("similarity") < MIN_SIMILARITY, "low_context_similarity"),
            F.when(~sure, "low_ocr_confidence"),
            F.when((F.col("trust") == "low") & ~supported, "no_full_page_corroboration"),
        )
    )
    said = F.when(F.size(against) > 0, F.array_join(against, ";")).otherwise("repair_not_safe_to_auto_apply")
    answer = lambda level, reason: F.struct(F.lit(level).alias("status"), reason.alias("reason"))
    return (
        F.when(F.col("candidate").isNull(), answer("REVIEW_REQUIRED", F.lit("missing_native_or_ocr_candidate")))
        .when(F.col("protected"), answer("REVIEW_REQUIRED", F.lit("protected_legal_or_numeric_content")))
        .when(sound & backed, answer("AUTO_REPAIRED", F.lit("ocr_geometry_context_and_independent_page_ocr_agree")))
        .otherwise(answer("REVIEW_REQUIRED", said))
    )


def repair(pages: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with reconciled_text and counts, and the decisions, those whose span isn't unique put back to review."""
    on = ["document", "page_number"]
    spot = text.unique_spot(F.col("native_text"), F.col("native"))
    checked = decided.join(pages.select(*on, "native_text"), on)
    lost = (F.col("status") == "AUTO_REPAIRED") & spot.isNull()
    checked = checked.withColumns(
        {
            "reason": F.when(lost, "native_span_not_unique_in_page_text").otherwise(F.col("reason")),
            "status": F.when(lost, "REVIEW_REQUIRED").otherwise(F.col("status")),
        }
    ).drop("native_text")
    edit = F.struct(F.col("native").alias("target"), F.col("candidate").alias("replacement"))
    by_page = checked.groupBy(*on).agg(
        F.collect_list(F.when(F.col("status") == "AUTO_REPAIRED", edit)).alias("edits"),
        F.count_if(F.col("status") == "AUTO_REPAIRED").alias("auto_repaired_count"),
        F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_required_count"),
    )
    rows = pages.join(by_page, on, "left")
    edits = F.coalesce("edits", F.array().cast("array<struct<target:string,replacement:string>>"))
    rows = rows.withColumns(
        {
            "reconciled_text": text.replace_once(F.col("native_text"), edits),
            "auto_repaired_count": F.coalesce("auto_repaired_count", F.lit(0)),
            "review_required_count": F.coalesce("review_required_count", F.lit(0)),
        }
    )
    return rows.drop("edits"), checked
