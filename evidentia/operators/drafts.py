"""Drafts and results: completeness of material, validation with issue rows, gates, command checks, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import hashing, text


def material(texts: DataFrame, title: str, cue: str, answer: str) -> DataFrame:
    """(document, status, missing): title, cue and answer must stand in this order, and the answer not be empty."""
    body = F.col("text")
    at = lambda pattern: F.regexp_instr(body, F.lit(pattern))
    rows = texts.withColumns({"t": at(title), "c": at(cue), "a": at(answer)})
    checks = F.array(
        F.when(F.col("t") == 0, "title"),
        F.when((F.col("c") == 0) | (F.col("c") < F.col("t")), "cue"),
        F.when((F.col("a") == 0) | (F.col("a") < F.col("c")), "answer_start"),
        F.when((F.col("a") > 0) & (F.length(text.strip(F.substr(body, F.col("a")))) <= 40), "answer_end"),
    )
    return rows.withColumn("missing", F.array_compact(checks)).select("document", F.when(F.size("missing") == 0, "PASS").otherwise("FAIL").alias("status"), "missing")


def result_issues(results: DataFrame, identity: DataFrame) -> DataFrame:
    """(result, issue, location) of results against the identity (result, subject, question, source_sha256, pages) they answer.

    Results have those columns too, and reviewed_pages, unresolved array<string>, and cards array<struct<front, back, scope>>.
    """
    rows = results.alias("r").join(identity.alias("i"), "result", "left")
    differs = lambda c: ~F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}"))
    whole = F.array_compact(
        F.array(
            F.when(differs("subject"), "SUBJECT_MISMATCH"),
            F.when(differs("question"), "QUESTION_MISMATCH"),
            F.when(differs("source_sha256"), "SOURCE_HASH_MISMATCH"),
            F.when(~F.array_sort("r.pages").eqNullSafe(F.array_sort("i.pages")), "PAGES_MISMATCH"),
            F.when(F.size(F.array_except("i.pages", F.coalesce("r.reviewed_pages", F.array().cast("array<int>")))) > 0, "REVIEW_INCOMPLETE"),
            F.when(F.size("r.unresolved") > 0, "UNRESOLVED_ITEMS"),
            F.when(F.coalesce(F.size("r.cards"), F.lit(0)) <= 0, "NO_CARDS"),
        )
    )
    found = rows.select("result", F.explode(whole).alias("issue"), F.lit("result").alias("location"))
    cards = results.select("result", F.posexplode("cards").alias("n", "c"))
    again = F.count("*").over(W.partitionBy("result", text.compact(F.coalesce("c.front", F.lit("")))))
    per_card = F.array_compact(
        F.array(
            F.when(text.strip(F.coalesce("c.front", F.lit(""))) == "", "BLANK_FRONT"),
            F.when(text.strip(F.coalesce("c.back", F.lit(""))) == "", "BLANK_BACK"),
            F.when(text.has_bad_control(F.concat_ws("", "c.front", "c.back")), "CONTROL_CHARACTERS"),
            F.when(again > 1, "DUPLICATE_FRONT"),
        )
    )
    cards = cards.withColumn("issues", per_card)
    return found.unionByName(cards.select("result", F.explode("issues").alias("issue"), F.format_string("cards[%d]", "n").alias("location")))


def draft_texts(drafts: DataFrame) -> DataFrame:
    """(draft, location, text) of all texts of cards (front, back, extra) and note blocks."""
    cards = drafts.select("draft", F.posexplode("cards").alias("n", "c"))
    fields = F.explode(F.create_map(*[v for f in ("front", "back", "extra") for v in (F.lit(f), F.col(f"c.{f}"))])).alias("field", "text")
    cards = cards.select("draft", "n", fields).select("draft", F.format_string("cards[%d].%s", "n", "field").alias("location"), "text")
    notes = drafts.select("draft", F.posexplode("notes").alias("n", "text")).select("draft", F.format_string("notes[%d]", "n").alias("location"), "text")
    return cards.unionByName(notes).where("text is not null")


def review_gates(drafts: DataFrame) -> DataFrame:
    """(draft, gate, subject) that block a draft: open uncertainties, reviews not done, unresolved ids."""
    uncertain = drafts.select("draft", F.explode("uncertainties").alias("u")).where("u.blocking").select("draft", F.lit("BLOCKING_UNCERTAINTY").alias("gate"), F.col("u.id").alias("subject"))
    visual = drafts.select("draft", F.explode("visual_reviews").alias("v")).where("not coalesce(v.done, false)").select("draft", F.lit("VISUAL_REVIEW_INCOMPLETE").alias("gate"), F.col("v.page").cast("string").alias("subject"))
    ids = drafts.select("draft", F.explode("unresolved_ids").alias("subject")).select("draft", F.lit("UNRESOLVED_ID").alias("gate"), "subject")
    return uncertain.unionByName(visual).unionByName(ids)


def acceptance(responses: DataFrame) -> DataFrame:
    """Responses with stage and accepted: the first of JSON, object, schema, provenance and gates that fails, else ACCEPTED.

    Columns: raw, schema_ok, provenance_ok, gates_ok.
    """
    parsed = F.try_parse_json("raw")
    stage = (
        F.when(parsed.isNull(), "INVALID_JSON")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "NOT_AN_OBJECT")
        .when(~F.coalesce("schema_ok", F.lit(False)), "SCHEMA")
        .when(~F.coalesce("provenance_ok", F.lit(False)), "PROVENANCE")
        .when(~F.coalesce("gates_ok", F.lit(False)), "GATES")
        .otherwise("ACCEPTED")
    )
    return responses.withColumn("stage", stage).withColumn("accepted", F.col("stage") == "ACCEPTED")


def command_issues(commands: DataFrame, folder: str) -> DataFrame:
    """(command_id, issue) of commands: id characters, result folder and name, hash, time with offset, approval by action."""
    registers = F.coalesce("registration_authorized", F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("command_id").rlike("^[A-Za-z0-9._-]{1,128}$"), F.lit(False)), "BAD_COMMAND_ID"),
            F.when(~F.coalesce(F.regexp_replace("result_file", "/[^/]*$", "") == folder, F.lit(False)) | ~hashing.is_relative(F.col("result_file")), "BAD_RESULT_PATH"),
            F.when(~F.coalesce(F.col("result_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "BAD_HASH"),
            F.when(~hashing.has_offset(F.col("approved_at")), "BAD_APPROVAL_TIME"),
            F.when(~F.coalesce(F.col("action").isin("apply", "apply_and_register"), F.lit(False)), "UNKNOWN_ACTION"),
            F.when((F.col("action") == "apply_and_register") != registers, "AUTHORISATION_MISMATCH"),
        )
    )
    return commands.select("command_id", F.explode(found).alias("issue"))


def typed_markers(raw: DataFrame, pages: Column | None = None) -> DataFrame:
    """Marker payloads (payload JSON) as typed rows in order, those of requested pages, with issue where they are unsound."""
    schema = "id string, page_number int, color string, bbox array<double>, start_char int, end_char int, review_status string, exact_text string"
    rows = raw.select(F.from_json("payload", schema).alias("m")).select("m.*")
    rows = rows if pages is None else rows.where(pages.isNull() | F.array_contains(pages, F.col("page_number")))
    issue = (
        F.when(F.coalesce("id", F.lit("")) == "", "MISSING_ID")
        .when(F.coalesce(F.size("bbox"), F.lit(0)) != 4, "BAD_BBOX")
        .when(~F.coalesce(F.col("review_status").isin("AUTO_VERIFIED", "NEEDS_REVIEW", "UNRESOLVED"), F.lit(False)), "BAD_STATUS")
        .when(F.col("start_char").isNull() != F.col("end_char").isNull(), "HALF_A_RANGE")
        .when(F.col("start_char") > F.col("end_char"), "BAD_RANGE")
    )
    return rows.withColumn("issue", issue).withColumn("position", F.row_number().over(W.partitionBy("page_number").orderBy(F.coalesce("start_char", F.lit(-1)), "id")))


def bundle_changes(bound: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of bound files (path, sha256) against what is there: MISSING, CHANGED, or UNBOUND for extra ones."""
    other = now.select("path", F.col("sha256").alias("now"), F.lit(True).alias("there"))
    rows = bound.withColumn("bound", F.lit(True)).join(other, "path", "full")
    change = F.when(F.col("there").isNull(), "MISSING").when(F.col("bound").isNull(), "UNBOUND").when(~F.col("sha256").eqNullSafe(F.col("now")), "CHANGED")
    return rows.select("path", change.alias("change")).where("change is not null")


def preflight(cards: DataFrame, options: DataFrame, existing: DataFrame) -> DataFrame:
    """Cards (name, option, content) with action: UNKNOWN_OPTION, DUPLICATE_IN_BATCH, RESUMABLE if the same row exists, DUPLICATE if another does, else CREATE."""
    rows = cards.join(options.select("option", F.lit(True).alias("known")), "option", "left")
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("name")))
    rows = rows.join(existing.select("name", F.col("content").alias("held")), "name", "left")
    action = (
        F.when(F.col("known").isNull(), "UNKNOWN_OPTION")
        .when(F.col("n") > 1, "DUPLICATE_IN_BATCH")
        .when(F.col("held").isNull(), "CREATE")
        .when(F.col("held") == F.col("content"), "RESUMABLE")
        .otherwise("DUPLICATE")
    )
    return rows.select("name", "option", action.alias("action"))


def compact_markers(markers: DataFrame, keep: list[str]) -> DataFrame:
    """Allowed fields only, with the evidence image left out for verified markers."""
    image = F.when(F.col("review_status") != "AUTO_VERIFIED", F.col("evidence_image")).alias("evidence_image")
    return markers.select(*[c for c in keep if c in markers.columns and c != "evidence_image"], image)


def completions(resolved: DataFrame, states: DataFrame, queue: DataFrame) -> DataFrame:
    """Work to enqueue: each question's latest completion whose state is stable for the same source and not queued yet."""
    key = ["subject", "question", "source_sha256"]
    nth = F.row_number().over(W.partitionBy("subject", "question").orderBy(F.desc("done_page")))
    latest = resolved.withColumn("nth", nth).where("nth = 1").drop("nth")
    ready = states.where("status = 'SYNC_STABLE'").select(*key)
    return latest.join(ready, key, "left_semi").join(queue.select(*key), key, "left_anti")


def instruction_names(subjects: Column, with_notes: Column) -> Column:
    """Ordered instruction documents of a subject; null for an unknown one."""
    common = [F.lit("common.md"), F.when(with_notes, F.lit("notes.md"))]
    own = F.concat(subjects, F.lit(".md"))
    return F.when(F.length(text.strip(F.coalesce(subjects, F.lit("")))) > 0, F.array_compact(F.array(*common, own)))


def prompt(sections: DataFrame) -> DataFrame:
    """(bundle, prompt): sections (bundle, position, heading, body) rendered in order."""
    block = F.concat(F.lit("## "), "heading", F.lit("\n\n"), "body")
    ordered = F.array_sort(F.collect_list(F.struct("position", block.alias("b"))))
    return sections.groupBy("bundle").agg(F.array_join(F.transform(ordered, lambda s: s["b"]), "\n\n").alias("prompt"))
