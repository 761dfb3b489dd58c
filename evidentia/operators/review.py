"""Open issues rolled up to page tasks, canonical documents, their rendering and validation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ON = ("document", "page_number")
#: Characters of a rendered document after which it goes on in another part.
PART_CHARS = 32 << 20


def issues(decisions: DataFrame, records: DataFrame, markers: DataFrame) -> DataFrame:
    """(document, page_number, category, id, reason, status) of everything that wants a person's eye.

    Repairs stand for surgical records; full-page records count only if unresolved.
    """
    def named(rows: DataFrame, category: Column, id: str, status: Column) -> DataFrame:
        return rows.select(*ON, category.alias("category"), F.col(id).alias("id"), "reason", status.alias("status"))

    repairs = decisions.where("status = 'REVIEW_REQUIRED'")
    quiet = (F.col("kind") == "suspect_native_text") | ((F.col("kind") == "full_page") & (F.col("review_status") != "UNRESOLVED"))
    evidence = records.where((F.col("review_status") != "AUTO_VERIFIED") & ~quiet)
    category = (
        F.when(F.col("kind") == "image_region", "image_region_page")
        .when(F.col("kind") == "red_vector_cluster", "visual_markup_page")
        .otherwise("unresolved_evidence_page")
    )
    marks = markers.where("review_status <> 'AUTO_VERIFIED'").withColumn("reason", F.lit("marker_boundary_requires_review"))
    return (
        named(repairs, F.lit("text_repair_page"), "record_id", F.lit("NEEDS_REVIEW"))
        .unionByName(named(evidence, category, "record_id", F.col("review_status")))
        .unionByName(named(marks, F.lit("visual_markup_page"), "id", F.col("review_status")))
    )


def page_tasks(found: DataFrame) -> DataFrame:
    """One task for each page: its categories, issues in order, and UNRESOLVED if any issue is."""
    return found.groupBy(*ON).agg(
        F.array_sort(F.collect_set("category")).alias("review_categories"),
        F.count("*").alias("issue_count"),
        F.array_sort(F.collect_list(F.struct("category", "id", "reason", "status"))).alias("issues"),
        F.when(F.bool_or(F.col("status") == "UNRESOLVED"), "UNRESOLVED").otherwise("NEEDS_REVIEW").alias("status"),
    ).withColumn("reason", F.concat(F.lit("review_items="), "issue_count", F.lit(";categories="), F.array_join("review_categories", ",")))


def category_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("n_issues"), F.countDistinct(*ON).alias("n_pages"))


def canonical(pages: DataFrame, tasks: DataFrame, supplements: DataFrame, markers: DataFrame) -> DataFrame:
    """Nested pages: text, sorted supplements and markers, and the page's task, one row a page."""
    extra = supplements.groupBy(*ON).agg(F.array_sort(F.collect_list(F.struct("record_id", "kind", "ocr_text", "ocr_confidence", "review_status"))).alias("supplements"))
    marks = markers.groupBy(*ON).agg(F.array_sort(F.collect_list(F.struct("id", "color", "review_status"))).alias("markers"))
    task = tasks.select(*ON, F.struct("status", "issue_count", "review_categories", "issues").alias("task"))
    return pages.join(extra, list(ON), "left").join(marks, list(ON), "left").join(task, list(ON), "left")


def handoff_page(with_markers: bool = True) -> Column:
    """Markdown of one canonical page."""
    right = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    primary = F.coalesce(right(F.col("canonical_text")), F.lit("[No independent full-page OCR available. Inspect the review sheet.]"))
    categories = F.coalesce(F.array_join("task.review_categories", ", "), F.lit(""))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("## PDF page "), F.col("page_number").cast("string")),
        F.lit(""),
        F.concat(F.lit("- Text-layer trust: "), "trust"),
        F.concat(F.lit("- Text-layer origin: "), "origin"),
        F.concat(F.lit("- Primary text source: "), "canonical_source"),
        F.concat(F.lit("- Review categories: ["), categories, F.lit("]")),
        F.lit(""),
        F.lit("### Primary Reading Text"),
        F.lit(""),
        primary,
        F.lit(""),
    )
    images = F.filter(F.coalesce("supplements", F.array().cast("array<struct<record_id:string,kind:string,ocr_text:string,ocr_confidence:double,review_status:string>>")), lambda s: s["kind"] == "image_region")
    shown = F.transform(images, lambda s: F.concat(F.lit("#### "), s["record_id"], F.lit("\n\n"), s["ocr_text"], F.lit("\n")))
    pasted = F.when(F.size(images) > 0, F.concat(F.lit("### OCR-only Pasted / Image Material\n\n"), F.array_join(shown, "\n")))
    count = lambda key: F.size(F.filter("markers", lambda m: F.concat_ws(" / ", m["color"], m["review_status"]) == key)).cast("string")
    keys = F.array_sort(F.array_distinct(F.transform("markers", lambda m: F.concat_ws(" / ", m["color"], m["review_status"]))))
    summary = F.when(F.size("markers") > 0, F.concat(F.lit("### PDF Marking Summary\n\n"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit("- "), k, F.lit(": "), count(k))), "\n"), F.lit("\n")))
    return F.concat_ws("\n", head, pasted, summary) if with_markers else F.concat_ws("\n", head, pasted)


def _parts(pages: DataFrame, most: int) -> DataFrame:
    """(document, part, body): `page` texts in order, joined by line ends, in parts of about `most` characters.

    Parts joined as they are make the whole text; no task holds more than a part, however long a document is.
    """
    order = W.partitionBy("document").orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("page").cast("long") + 1).over(order), F.lit(0))
    rows = pages.select("document", "page_number", "page", F.floor(before / most).cast("int").alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page"))), lambda p: p["page"]), "\n")
    rows = rows.groupBy("document", "part").agg(body.alias("body"))
    return rows.select("document", "part", F.concat(F.when(F.col("part") > 0, "\n").otherwise(""), "body").alias("body"))


def _heads(pages: DataFrame) -> DataFrame:
    """(document, head): frontmatter and title of each document."""
    head = F.concat(F.lit("---\nhandoff_schema_version: 2\nsource: "), F.to_json(F.struct("document")), F.lit("\npage_review_count: "), F.col("n_tasks").cast("string"), F.lit("\n---\n\n# Page Reading Pack\n\n"))
    return pages.groupBy("document").agg(F.count("task").alias("n_tasks")).select("document", head.alias("head"))


def handoff(pages: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """(document, part, markdown): frontmatter and all pages in order, in parts of about `most` characters."""
    rows = _parts(pages.withColumn("page", handoff_page()), most).join(_heads(pages), "document")
    return rows.select("document", "part", F.concat(F.when(F.col("part") == 0, F.col("head")).otherwise(""), "body").alias("markdown"))


def handoff_hash(pages: DataFrame) -> DataFrame:
    """(document, markdown_sha256): hash of each document's whole Markdown, all parts of `handoff` as one.

    A document's pages pass one task in order, a batch at a time; the text is never put together.
    """
    none = F.lit(None).cast(pages.schema["page_number"].dataType)
    heads = _heads(pages).select("document", F.lit(0).alias("step"), none.alias("page_number"), F.col("head").alias("piece"))
    rows = heads.unionByName(pages.select("document", F.lit(1).alias("step"), "page_number", handoff_page().alias("piece")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, document, first, done = None, None, True, []
        for batch in batches:
            columns = (batch["document"], batch["step"], batch["piece"].cast(pa.binary()))
            for name, step, piece in zip(*[c.to_pylist() for c in columns], strict=True):
                if step == 0:
                    if state is not None:
                        done.append((document, state.hexdigest()))
                    state, document, first = hashlib.sha256(), name, True
                elif not first:
                    state.update(b"\n")
                first = step == 0
                state.update(piece)
        if state is not None:
            done.append((document, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*done) if done else ([], []))], ["document", "markdown_sha256"])

    sorted_rows = rows.repartition("document").sortWithinPartitions("document", "step", "page_number", "piece").select("document", "step", "piece")
    return sorted_rows.mapInArrow(run, "document string, markdown_sha256 string")


def audit(pages: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """(document, part, markdown): reconciled text, the embedded text as evidence, and open issues, page by page, in parts."""
    line = F.transform(F.col("task.issues"), lambda i: F.concat(F.lit("- "), i["category"], F.lit(" / "), i["id"], F.lit(": "), i["reason"]))
    page = F.concat_ws(
        "\n",
        F.concat(F.lit("## PDF page "), F.col("page_number").cast("string")), F.lit(""), "reconciled_text", F.lit(""),
        F.lit("### Embedded"), F.lit(""), "native_text", F.lit(""),
        F.lit("### Needs Review"), F.lit(""), F.coalesce(F.array_join(line, "\n"), F.lit("No unresolved or review-required evidence.")), F.lit(""),
    )
    return _parts(pages.withColumn("page", page), most).withColumnRenamed("body", "markdown")


def evidence_index(*sources: DataFrame) -> DataFrame:
    """Union of evidence (evidence_id, page_number, kind, artifact, review_required); an id of two provenances is conflicting."""
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("evidence_id").agg(
        F.min("page_number").alias("page_number"),
        F.min("kind").alias("kind"),
        F.min("artifact").alias("artifact"),
        F.bool_or("review_required").alias("review_required"),
        (F.countDistinct(F.struct("page_number", "kind", "artifact")) > 1).alias("conflicting"),
    )


def reference_issues(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(location, evidence_id, issue) for references that don't match the evidence they name."""
    named = index.select("evidence_id", F.col("page_number").alias("p"), F.col("kind").alias("k"), F.col("artifact").alias("a"), F.col("review_required").alias("r"), F.lit(True).alias("known"))
    rows = refs.join(named, "evidence_id", "left")
    known = F.coalesce("known", F.lit(False))
    differs = lambda mine, theirs: known & ~F.col(mine).eqNullSafe(F.col(theirs))
    found = F.array_compact(
        F.array(
            F.when(~known, "UNKNOWN_EVIDENCE_ID"),
            F.when(differs("page_number", "p"), "PAGE_MISMATCH"),
            F.when(differs("kind", "k"), "SOURCE_KIND_MISMATCH"),
            F.when(differs("artifact", "a"), "ARTIFACT_MISMATCH"),
            F.when(known & F.col("r") & ~F.coalesce("review_required", F.lit(False)), "REVIEW_FLAG_DROPPED"),
        )
    )
    return rows.select("location", "evidence_id", F.explode(found).alias("issue"))


def flattened_refs(drafts: DataFrame) -> DataFrame:
    """References of drafts (draft, cards array<struct<refs>>, notes array<struct<refs>>) with where they stand."""
    parts = []
    for name in ("cards", "notes"):
        rows = drafts.select("draft", F.posexplode(name).alias("i", "x")).select("draft", "i", F.posexplode("x.refs").alias("j", "ref"))
        parts.append(rows.select("draft", F.format_string(f"{name}[%d].refs[%d]", "i", "j").alias("location"), "ref.*"))
    return parts[0].unionByName(parts[1])


def validation(checks: DataFrame, key: str = "document") -> DataFrame:
    """(key, valid, failed) from rows (key, check, passed): every check must pass; a null one fails."""
    passed = F.coalesce("passed", F.lit(False))
    return checks.groupBy(key).agg(
        F.bool_and(passed).alias("valid"), F.array_sort(F.collect_set(F.when(~passed, F.col("check")))).alias("failed"), F.count("*").alias("n_checks")
    )


def identity_issues(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(field, left, right) for each column in which two one-row tables differ."""
    a, b = left.select([F.col(c).cast("string").alias(f"l_{c}") for c in columns]), right.select([F.col(c).cast("string").alias(f"r_{c}") for c in columns])
    both = a.limit(1).join(F.broadcast(b.limit(1)), how="cross")  # one row each
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right")) for c in columns]
    return both.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where(~F.col("left").eqNullSafe(F.col("right")))
