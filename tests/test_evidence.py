"""Trust, alignment, reconciliation, repair, markers, review and retrieval on small fixtures."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import alignment, headings, markers, pages, reconciliation, retrieval, review, routing, sets
from evidentia.plans import ingest
from evidentia.sources import files, sinks

TEXT = "This page has enough text to be compared with another one by its similarity, line after line."


def page_rows(spark, rows):
    schema = "document string, page_number int, width double, height double, rotation int, native_text string, vector string"
    return pages.identity(spark.createDataFrame([("d", n, 595.0, 842.0, 0, t, v) for n, t, v in rows], schema))


def test_trust_rules(spark):
    rows = [(0, 0.0, 0, 0, 0.0, 0, 0.9), (0, 0.0, 0, 0, 0.0, 0, 0.0), (900, 0.9, 15, 0, 0.001, 5, 0.0), (900, 0.94, 0, 0, 0.0, 0, 0.0), (900, 0.99, 0, 0, 0.0, 0, 0.1), (900, 0.96, 0, 0, 0.0, 0, 0.1), (900, 0.99, 0, 1, 0.0, 0, 0.1)]
    frame = spark.createDataFrame(rows, "c int, q double, g int, t int, r double, s int, i double")
    found = frame.select(pages.trust(*map(F.col, "cqgtrsi")).alias("t")).collect()
    assert [r.t.trust for r in found] == ["low", "low", "low", "medium", "high", "medium", "low"]
    assert [r.t.origin for r in found][:3] == ["scan_like", "unknown", "embedded_ocr_or_corrupt_mapping_likely"]


def test_alignment_classes(spark):
    old = page_rows(spark, [(1, "a" * 50, "v"), (2, "b" * 50, "v"), (3, TEXT * 2, "v"), (4, "gone", "v"), (5, "same", "v"), (6, "same", "v")])
    new = page_rows(spark, [(1, "new", "v"), (2, "a" * 50, "v"), (3, TEXT * 2 + "!", "v"), (4, "b" * 50, "w"), (5, "same", "v")])
    found = {(r.previous_page, r.current_page): r for r in alignment.align(old, new).collect()}
    classes = {k: r.classification for k, r in found.items()}
    assert classes == {
        (1, 2): "MOVED", (2, 4): "MOVED_MARKUP_CHANGED", (3, 3): "CONTENT_CHANGED", (4, None): "DELETED", (5, 5): "SAME", (6, None): "DELETED", (None, 1): "NEW",
    }
    assert found[1, 2].reusable and not found[3, 3].reusable and 0.985 <= found[3, 3].similarity < 1


def test_greedy_ties(spark):
    pairs = spark.createDataFrame([("d", 1, 1, 0.99), ("d", 1, 2, 0.995), ("d", 2, 2, 0.995), ("d", 2, 1, 0.99)], "document string, previous_page int, current_page int, similarity double")
    assert {(r.previous_page, r.current_page) for r in alignment.greedy(pairs).collect()} == {(1, 2), (2, 1)}


def test_revisions(spark):
    items = spark.createDataFrame([("d", "q1", [1, 2]), ("d", "q2", [3])], "document string, item string, pages array<int>")
    moved = spark.createDataFrame([("d", 2, 3, "CONTENT_CHANGED"), ("d", 3, 4, "MOVED")], "document string, previous_page int, current_page int, classification string")
    assert [(r.item, r.current_page) for r in alignment.revisions(items, moved).collect()] == [("q1", 3)]


def test_identity_ignores_image_order_and_drawings(spark):
    schema = "document string, page_number int, width double, height double, rotation int, native_text string, images array<struct<digest:string,bbox:array<double>,width_px:int,height_px:int>>, vector string"
    a, b = ("aa", [0.0, 0.0, 1.0, 1.0], 5, 5), ("bb", [1.0, 1.0, 2.0, 2.0], 5, 5)
    rows = [("d", 1, 1.0, 1.0, 0, "x", [a, b], "v"), ("d", 2, 1.0, 1.0, 0, " x\n", [b, a], "w"), ("d", 3, 1.0, 1.0, 0, "", [], "v"), ("d", 4, 1.0, 1.0, 0, "", [], "w")]
    ids = [r.stable_page_id for r in pages.identity(spark.createDataFrame(rows, schema)).orderBy("page_number").collect()]
    assert ids[0] == ids[1] and ids[2] != ids[3]


def test_explodes(spark):
    schema = "document string, page_number int, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string,chars:array<struct<c:string,bbox:array<double>>>>>>>>>"
    box = [0.0, 0.0, 1.0, 1.0]
    blocks = [(0, [([("ab", [("a", box), ("?", [0.0])]), ("", [])],), ([("c", [("c", box)])],)]), (1, [([("img", [("i", box)])],)])]
    frame = spark.createDataFrame([("d", 1, blocks)], schema)
    assert [(r["index"], r.c) for r in pages.chars(frame).orderBy("index").collect()] == [(0, "a"), (1, "c")]
    assert [r.text for r in pages.spans(frame).collect()] == ["ab", "c"]
    assert pages.numbered(frame, "blocks").count() == 2


def evidence(spark, rows):
    schema = (
        "document string, page_number int, ordinal int, record_id string, kind string, status string, native_candidate string, bbox array<double>, native_bbox array<double>, "
        "padding double, text string, confidence double, lines array<struct<text:string,confidence:double,pdf_bbox:array<double>>>"
    )
    return spark.createDataFrame(rows, schema)


BOX, FAR = [0.0, 0.0, 10.0, 10.0], [50.0, 50.0, 60.0, 60.0]


def test_reconciliation_statuses(spark):
    rows = [
        ("d", 1, 0, "r1", "suspect_native_text", "completed", "abc", BOX, BOX, 0.0, None, None, [("zzz", 0.5, FAR), ("abc", 0.9, BOX), ("abd", 0.9, BOX)]),
        ("d", 1, 1, "r2", "suspect_native_text", "completed", "abc", BOX, BOX, 0.0, None, None, [("abc", 0.9, FAR)]),
        ("d", 1, 2, "r3", "suspect_native_text", "completed", "abc", BOX, BOX, 0.0, None, None, [("xyz", 0.9, BOX)]),
        ("d", 1, 3, "r4", "image_region", "completed", None, BOX, None, None, "seen", 0.8, None),
        ("d", 1, 4, "r5", "full_page", "not_executed_no_backend", None, BOX, None, None, None, None, None),
        ("d", 1, 5, "r6", "suspect_native_text", "completed", "abc", [0.0, 0.0, 22.0, 22.0], None, 6.0, None, None, [("abc", 0.9, [6.0, 6.0, 16.0, 16.0])]),
    ]
    found = {r.record_id: r for r in reconciliation.reconcile(evidence(spark, rows)).collect()}
    assert {k: r.review_status for k, r in found.items()} == {"r1": "AUTO_VERIFIED", "r2": "NEEDS_REVIEW", "r3": "NEEDS_REVIEW", "r4": "NEEDS_REVIEW", "r5": "UNRESOLVED", "r6": "AUTO_VERIFIED"}
    assert found["r1"].reason == "normalized_exact_with_coordinate_overlap" and found["r1"].ocr_text == "abc"
    assert found["r2"].coordinate_match is False and found["r4"].coordinate_match is None
    assert found["r4"].selected_source == "ocr_supplement" and found["r5"].reason == "not_executed_no_backend"


GOOD = dict(candidate="x", protected=False, coordinate_match=True, ocr_confidence=0.9, noise_before=2, noise_after=0, support=True, similarity=0.9, length_ratio=1.0, trust="low")


@pytest.mark.parametrize(
    ("change", "status", "reason"),
    [
        ({}, "AUTO_REPAIRED", "ocr_geometry_context_and_independent_page_ocr_agree"),
        ({"support": None}, "REVIEW_REQUIRED", "no_full_page_corroboration"),
        ({"support": None, "trust": "medium"}, "AUTO_REPAIRED", "ocr_geometry_context_and_independent_page_ocr_agree"),
        ({"support": None, "trust": "medium", "similarity": 0.8}, "REVIEW_REQUIRED", "repair_not_safe_to_auto_apply"),
        ({"support": False, "trust": "medium"}, "REVIEW_REQUIRED", "repair_not_safe_to_auto_apply"),
        ({"protected": True}, "REVIEW_REQUIRED", "protected_legal_or_numeric_content"),
        ({"candidate": None}, "REVIEW_REQUIRED", "missing_native_or_ocr_candidate"),
        ({"coordinate_match": None, "ocr_confidence": None}, "REVIEW_REQUIRED", "coordinate_mismatch;low_ocr_confidence"),
        ({"similarity": 0.5, "noise_after": 2}, "REVIEW_REQUIRED", "ocr_does_not_reduce_suspicious_content;low_context_similarity"),
    ],
)
def test_repair_verdicts(spark, change, status, reason):
    row = GOOD | change
    schema = "candidate string, protected boolean, coordinate_match boolean, ocr_confidence double, noise_before int, noise_after int, support boolean, similarity double, length_ratio double, trust string"
    found = spark.createDataFrame([tuple(row.values())], schema).select(reconciliation.verdict().alias("v")).first().v
    assert (found.status, found.reason) == (status, reason)


def test_repair_applies_unique_spans_only(spark):
    page = spark.createDataFrame([("d", 1, "前のΧΧ文、 後のЖ文 Ж", "medium")], "document string, page_number int, native_text string, trust string")
    schema = "document string, page_number int, record_id string, native string, candidate string, status string, reason string"
    decided = spark.createDataFrame([("d", 1, "a", "ΧΧ", "良い", "AUTO_REPAIRED", "ok"), ("d", 1, "b", "Ж", "別", "AUTO_REPAIRED", "ok")], schema)
    repaired, checked = reconciliation.repair(page, decided)
    row = repaired.first()
    assert row.reconciled_text == "前の良い文、 後のЖ文 Ж" and (row.auto_repaired_count, row.review_required_count) == (1, 1)
    assert {r.record_id: r.reason for r in checked.collect()} == {"a": "ok", "b": "native_span_not_unique_in_page_text"}


def test_ingest_resumes(spark, tmp_path):
    table = spark.createDataFrame([("d", 1, 595.0, 842.0, 0, "本文です。" * 50, 0.0, 0.0), ("d", 2, 595.0, 842.0, 0, "", 1.0, 1.0)], "document string, page_number int, width double, height double, rotation int, native_text string, image_coverage double, largest_image_coverage double")
    rows = [("d", 2, 0, "x", "full_page", "completed", None, BOX, None, None, "認識した文", 0.9, None), ("d", 1, 0, "x", "image_region", "completed", None, BOX, None, None, "図", 0.8, None)]
    marks = spark.createDataFrame([("d", 1, "m1", "yellow", "NEEDS_REVIEW")], "document string, page_number int, id string, color string, review_status string")
    run = ingest.Run(spark, f"file://{tmp_path}", "run1")
    first = {r.page_number: r for r in ingest.ingest(run, table, evidence(spark, rows), marks, "h1").collect()}
    assert first[2].canonical_text == "認識した文" and first[2].trust == "low" and first[1].canonical_source == "reconciled_text"
    assert first[1].task.review_categories == ["image_region_page", "visual_markup_page"] and first[2].task is None
    assert run.reused == []
    again = ingest.Run(spark, f"file://{tmp_path}", "run1")
    ingest.ingest(again, table, evidence(spark, rows), marks, "h1")
    assert len(again.reused) == 8
    changed = ingest.Run(spark, f"file://{tmp_path}", "run1")
    ingest.ingest(changed, table, evidence(spark, rows), marks, "h2")
    assert changed.reused == []
    text = review.handoff(ingest.ingest(changed, table, evidence(spark, rows), marks, "h2")).first().markdown
    assert "## PDF page 1" in text and "#### p0001-ocr-001" in text and "- yellow / NEEDS_REVIEW: 1" in text
    assert "認識した文" in text and "page_review_count: 1" in text


def test_anchored_markers(spark):
    schema = "document string, page_number int, id string, color string, paint string, bbox array<double>, stroke_width double, exact_text string, review_status string"
    rows = [("d", 1, "u", "yellow", "stroke", [0.0, 5.0, 50.0, 5.0], 8.0, "unique", "AUTO_VERIFIED"), ("d", 1, "r", "yellow", "fill", [0.0, 0.0, 50.0, 10.0], 0.0, "twice", "AUTO_VERIFIED"), ("d", 9, "p", "yellow", "fill", BOX, 0.0, "x", "AUTO_VERIFIED")]
    page = spark.createDataFrame([("d", 1, "unique twice twice", "reconciled_text", 100.0, 100.0, 0)], "document string, page_number int, canonical_text string, canonical_source string, width double, height double, rotation int")
    lines = spark.createDataFrame([("d", 1, 0, 6, [0.0, 0.0, 50.0, 9.0])], "document string, page_number int, start int, stop int, bbox array<double>")
    found = {r.id: (r.canonical_start, r.canonical_stop) for r in markers.anchored(spark.createDataFrame(rows, schema), page, lines).collect()}
    assert found == {"u": (0, 6), "r": (0, 6), "p": (None, None)}


def test_lexical_search(spark):
    notes = spark.createDataFrame([("P-1", "Good faith", ["bona fides"], "text a"), ("P-2", "Bad faith", [], "about good faith"), ("P-3", "Other", ["x good faith y"], "")], "note_id string, title string, aliases array<string>, body string")
    queries = spark.createDataFrame([(1, "GOOD FAITH"), (2, "faith"), (3, "p-2"), (4, "  "), (5, "nothing")], "query_id int, text string")
    found = retrieval.search(queries, notes)
    got = sorted((r.query_id, r.position, r.note_id, r.match_rank) for r in found.collect())
    assert got == [(1, 1, "P-1", 2), (2, 1, "P-1", 2), (2, 2, "P-2", 2), (2, 3, "P-3", 3), (3, 1, "P-2", 0)]
    assert {r.query_id: r.n_matched for r in retrieval.attempts(queries, found).collect()} == {1: 1, 2: 3, 3: 1, 4: 0, 5: 0}
    assert sorted((r.note_id, r.query_id) for r in retrieval.first_matches(found).collect()) == [("P-1", 1), ("P-2", 2), ("P-3", 2)]


def test_statute_outcomes(spark):
    table = spark.createDataFrame([("L", "1", "s1", "t"), ("L", "01", "s2", "t"), ("L", "2", "s3", " "), ("L", "3", "s4", "t")], "law string, article string, statute_id string, text string")
    asked = spark.createDataFrame([("L", "第1条"), ("L", "2"), ("L", "3"), ("L", "4"), ("L", "?")], "law string, article string")
    assert {r.article: r.outcome for r in retrieval.statutes(asked, table).collect()} == {"第1条": "AMBIGUOUS", "2": "BLANK_TEXT", "3": "FOUND", "4": "MISSING", "?": "BAD_ARTICLE"}


def test_headings(spark):
    cases = {"第1問": "ACCEPT_PROBLEM_START", "第1問 甲説\n答案例": "REJECT_AUXILIARY_HEADING", "第1問\n答案例 次の文": "ACCEPT_PROBLEM_START", "第1問\n第2問": "UNRESOLVED_AMBIGUOUS_HEADING", "目次 第1問": "REJECT_TABLE_OF_CONTENTS", "この第1問では": "REJECT_CROSS_REFERENCE", "第x問": "UNRESOLVED_AMBIGUOUS_HEADING", "本文": None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", headings.assess(F.col("t")).alias("h"))
    assert {r.t: r.h and r.h.decision for r in rows.collect()} == cases
    first = spark.createDataFrame([("第3問\n3-1 次の",)], "t string").select(headings.assess(F.col("t")).alias("h")).first().h
    assert first.reasons == ["exact_question_heading", "booklet_part_1", "problem_or_question_text"] and first.question == "3"
    note = spark.createDataFrame([("n", "intro\n## PDF page 2\nb\n## PDF page 10\nc\n## Other")], "note string, text string")
    assert {r.page_number: r.section for r in headings.sections(note).collect()} == {2: "## PDF page 2\nb", 10: "## PDF page 10\nc\n## Other"}


def test_routing_limits():
    for bad in ({"dpi": 72}, {"edge_band": 2.0}, {"repetitions": 2}, {"aspect_min": 3.0}):
        with pytest.raises(ValueError):
            routing.Routing(**bad)


def test_protected_images_are_no_noise(spark):
    regions = spark.createDataFrame([("d", 1, n, [5.0, y, 25.0, y + 20.0], 60, 60, 600.0, 850.0) for n, y in enumerate((100.0, 300.0, 500.0))], "document string, page_number int, image_index int, bbox array<double>, width_px int, height_px int, page_width double, page_height double")
    marks = spark.createDataFrame([("d", 1, [0.0, 90.0, 30.0, 130.0])], "document string, page_number int, mark_box array<double>")
    assert routing.edge_noise(regions, marks.limit(0), routing.Routing()).count() == 3
    assert routing.edge_noise(regions, marks, routing.Routing()).count() == 0


def test_sets(spark):
    rows = spark.createDataFrame([([1, 2], [2, 1]), ([1, 1], [1, 1]), ([1], [1, 2])], "a array<int>, b array<int>")
    found = rows.select(sets.same_set(F.col("a"), F.col("b")), sets.is_subset(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in found] == [(True, True), (False, True), (False, True)]


def test_json_markdown_and_zip_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.json").write_bytes(b"\xff\xfe")
    found = files.scan(spark, str(tmp_path), "*.json")
    issues = {r.path[-6:]: r.issue for r in files.json_objects(found).collect()}
    assert issues == {"a.json": None, "b.json": "NOT_AN_OBJECT", "c.json": "INVALID_JSON", "d.json": "NOT_UTF8"}
    assert {r.issue for r in files.documents(found).collect()} == {None, "NOT_UTF8"}
    assert files.directory_hash(found, str(tmp_path)).first().n_files == 4
    notes = spark.createDataFrame([("\ufeff---\r\nk: v\r\n---\r\nbody",), ("no fence",), ("---\n- a\n---\nx",)], "text string")
    assert [r.issue for r in files.frontmatter(notes).collect()] == [None, "MISSING_FENCE", "NOT_A_MAPPING"]
    members = spark.createDataFrame([("p", "a.txt", b"1"), ("p", "b.txt", b"2"), ("q", "../x", b"3")], "packet string, member string, content binary")
    built = sinks.packets(members).select(F.col("packet").alias("path"), "content")
    broken = spark.createDataFrame([("z", b"no zip")], "path string, content binary")
    checks = files.packet_checks(files.zip_members(built.union(broken)), ["a.txt"])
    verdict = {r.path: r.failed for r in review.validation(checks, "path").collect()}
    assert verdict["p"] == [] and "names_are_safe" in verdict["q"] and "archive_reads" in verdict["z"]
    manifest = spark.createDataFrame([(found.first().sha256, 999), ("none", 1)], "sha256 string, size long")
    assert {r.state for r in files.integrity(manifest, found).collect()} == {"CORRUPT", "MISSING"}


def test_cards_and_read_back(spark):
    schema = "result string, shared_extra string, cards array<struct<scope:string,front:string,back:string,extra:string>>"
    rows = spark.createDataFrame([("r", "S", [("problem", "f", "b", None), ("general", "f", "", "e"), ("odd", "", "b", None)])], schema)
    cards = sinks.expanded_cards(rows).first().cards
    assert [c.extra for c in cards] == ["S", "e", None]
    issues = {(r.location, r.issue) for r in sinks.card_issues(rows).collect()}
    assert issues == {("cards[0]", "DUPLICATE_FRONT"), ("cards[1]", "DUPLICATE_FRONT"), ("cards[1]", "BLANK_BACK"), ("cards[2]", "BLANK_FRONT"), ("cards[2]", "UNKNOWN_SCOPE")}
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z"), (3, "q", "q")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None)], "id int, p string, q string")
    assert {(r.id, r.field) for r in sinks.read_back(a, b, "id").collect()} == {(2, "q"), (3, "missing")}
    refs = spark.createDataFrame([("d", [([("e1", 1)],)], [])], "draft string, cards array<struct<refs:array<struct<evidence_id:string,page:int>>>>, notes array<struct<refs:array<struct<evidence_id:string,page:int>>>>")
    assert [(r.location, r.evidence_id) for r in review.flattened_refs(refs).collect()] == [("cards[0].refs[0]", "e1")]
    assert [r.field for r in review.identity_issues(a.where("id = 1"), a.where("id = 2"), ["p", "q"]).collect()] == ["p", "q"]
