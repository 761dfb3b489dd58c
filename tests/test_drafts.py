"""Indexes, structured texts and drafts on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from evidentia.functions import json as js
from evidentia.operators import drafts
from evidentia.sources import indexes


def test_index_cache(spark, tmp_path):
    root, built = f"file://{tmp_path}/ix", []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "p1"), (2, "p2")], "page_number int, stable_page_id string")

    assert [indexes.ensure_index(spark, root, "s1", name, build)[1] for name in ("a", "a", "b")] == [False, True, False]
    indexes.ensure_index(spark, root, "s2", "b", build)
    assert len(built) == 3 and indexes.load_index(spark, root, "s1").count() == 2
    with pytest.raises(FileNotFoundError):
        indexes.load_index(spark, root, "s3")
    both = spark.read.parquet(root)
    assert {r.embedded_sha256 for r in indexes.previous_index(both, "b", "s2").collect()} == {"s1"}
    assert indexes.previous_index(both, "a", "s2").count() == 0


def test_pages_by_id(spark):
    index = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3)], "stable_page_id string, page_number int")
    wanted = spark.createDataFrame([("a", "x", None), ("b", "y", None), ("c", "y", 3), ("d", "y", 1), ("e", "z", None)], "item string, stable_page_id string, page_number int")
    found = {r.item: (r.page_number, r.issue) for r in indexes.resolved_pages(wanted, index).collect()}
    assert found == {"a": (1, None), "b": (None, "AMBIGUOUS_PAGE_ID"), "c": (3, None), "d": (None, "PAGE_DOES_NOT_MATCH_ID"), "e": (None, "UNKNOWN_PAGE_ID")}
    runs = spark.createDataFrame([("r1", "s"), ("r2", "s")], "run_id string, subject string")
    assert indexes.manifest(runs, run_id="r1", subject="s").count() == 1
    for key in ({"subject": "s"}, {"subject": "t"}):
        with pytest.raises(LookupError):
            indexes.manifest(runs, **key)
    pages = spark.createDataFrame([(3, None), (3, [2, 1, 2]), (0, None)], "page_count int, requested_pages array<int>")
    assert [r.pages for r in indexes.effective_pages(pages).collect()] == [[1, 2, 3], [1, 2], []]


def test_json_functions(spark):
    rows = spark.createDataFrame([('{"a": 1}', '{"a": 1, "z": 2}', "[1]")], "good string, extra string, list string")
    read = lambda c: js.closed(F.col(c), "a int", ["a"])
    found = rows.select(read("good").alias("g"), read("extra").alias("e"), read("list").alias("l"), js.unknown_keys(F.col("extra"), ["a"]).alias("u")).first()
    assert found.g.a == 1 and found.e is None and found.l is None and found.u == ["z"]
    text = spark.createDataFrame([('{"source":{"p":"@@"}}',), ('{"source":{"p":"@@"},"q":"@@"}',), ('{"source":{"p":"x"}}',)], "t string")
    got = [r[0] for r in text.select(js.replace_sentinel(F.col("t"), "$.source.p", "@@", F.lit('a"b'))).collect()]
    assert json.loads(got[0]) == {"source": {"p": 'a"b'}} and "@@" in got[1] and got[2] == '{"source":{"p":"x"}}'
    schema = json.dumps({"title": "T", "properties": {"title": {"const": 1, "default": 2}, "b": {"type": "string"}}})
    strict = json.loads(spark.createDataFrame([(schema,)], "s string").select(js.strict_schema("s")).first()[0])
    assert strict == {"properties": {"title": {"enum": [1]}, "b": {"type": "string"}}, "required": ["b", "title"], "additionalProperties": False}
    bound = spark.createDataFrame([(schema, '{"b": "v", "c": 1}')], "s string, c string").select(js.bind_constants("s", "c")).first()[0]
    assert json.loads(bound)["properties"]["b"]["enum"] == ["v"]
    response = '{"status":"completed","output":[{"content":[{"type":"output_text","text":"t"}]}],"incomplete_details":{"reason":"max"}}'
    got = spark.createDataFrame([(response,)], "r string").select(js.response_fields(F.col("r")).alias("f")).first().f
    assert (got.status, got.refusal, got.incomplete_reason, got.text) == ("completed", None, "max", "t")
    request = '{"input":[{"content":[{"type":"input_image"},{"type":"input_text","text":"hello"}]}]}'
    assert spark.createDataFrame([(request,)], "r string").select(js.first_text(F.col("r"))).first()[0] == "hello"
    errors = spark.createDataFrame([([(["a", "0"], "bad"), (["b"], "worse")],)], "e array<struct<path:array<string>,message:string>>")
    assert errors.select(js.error_text(F.col("e"))).first()[0] == "a.0: bad; b: worse"
    assert spark.sql("select map('1', 'x') m").select(js.int_keys(F.col("m"))).first()[0] == {1: "x"}


def test_material(spark):
    long = "long answer " * 10
    rows = spark.createDataFrame([("a", f"Title\nQuestion: x\nAnswer: {long}"), ("b", "Title\nAnswer: x\nQuestion"), ("c", "")], "document string, text string")
    found = {r.document: (r.status, r.missing) for r in drafts.material(rows, "Title", "Question", "Answer").collect()}
    assert found == {"a": ("PASS", []), "b": ("FAIL", ["answer_start", "answer_end"]), "c": ("FAIL", ["title", "cue", "answer_start"])}


def test_result_issues(spark):
    schema = "result string, subject string, question string, source_sha256 string, pages array<int>, reviewed_pages array<int>, unresolved array<string>, cards array<struct<front:string,back:string,scope:string>>"
    good = ("ok", "s", "q", "h", [1, 2], [1, 2], [], [("f", "b", "x")])
    bad = ("bad", "t", "q", "h", [1], [1], ["u"], [("f", "", "x"), ("f ", "b\x07", "x")])
    who = spark.createDataFrame([(n, "s", "q", "h", [2, 1]) for n in ("ok", "bad")], "result string, subject string, question string, source_sha256 string, pages array<int>")
    found = {(r.result, r.issue, r.location) for r in drafts.result_issues(spark.createDataFrame([good, bad], schema), who).collect()}
    assert found == {
        ("bad", "SUBJECT_MISMATCH", "result"), ("bad", "PAGES_MISMATCH", "result"), ("bad", "REVIEW_INCOMPLETE", "result"), ("bad", "UNRESOLVED_ITEMS", "result"),
        ("bad", "BLANK_BACK", "cards[0]"), ("bad", "CONTROL_CHARACTERS", "cards[1]"), ("bad", "DUPLICATE_FRONT", "cards[0]"), ("bad", "DUPLICATE_FRONT", "cards[1]"),
    }


def test_gates_and_acceptance(spark):
    schema = "draft string, uncertainties array<struct<id:string,blocking:boolean>>, visual_reviews array<struct<page:int,done:boolean>>, unresolved_ids array<string>, cards array<struct<front:string,back:string,extra:string>>, notes array<string>"
    rows = spark.createDataFrame([("d", [("u1", True), ("u2", False)], [(1, True), (2, None)], ["x"], [("f", "b", None)], ["n"])], schema)
    assert {(r.gate, r.subject) for r in drafts.review_gates(rows).collect()} == {("BLOCKING_UNCERTAINTY", "u1"), ("VISUAL_REVIEW_INCOMPLETE", "2"), ("UNRESOLVED_ID", "x")}
    assert {(r.location, r.text) for r in drafts.draft_texts(rows).collect()} == {("cards[0].front", "f"), ("cards[0].back", "b"), ("notes[0]", "n")}
    rows = spark.createDataFrame([("{", True, True, True), ("[]", True, True, True), ("{}", False, True, True), ("{}", True, None, True), ("{}", True, True, False), ("{}", True, True, True)], "raw string, schema_ok boolean, provenance_ok boolean, gates_ok boolean")
    assert [r.stage for r in drafts.acceptance(rows).collect()] == ["INVALID_JSON", "NOT_AN_OBJECT", "SCHEMA", "PROVENANCE", "GATES", "ACCEPTED"]


def test_commands_and_preflight(spark):
    schema = "command_id string, action string, result_file string, result_sha256 string, approved_at string, registration_authorized boolean"
    rows = [("c-1", "apply", "in/r.json", "a" * 64, "2025-01-01T00:00:00Z", None), ("c 2", "apply_and_register", "in/../r.json", "x", "2025-01-01T00:00:00", False)]
    found = {(r.command_id, r.issue) for r in drafts.command_issues(spark.createDataFrame(rows, schema), "in").collect()}
    assert found == {("c 2", i) for i in ("BAD_COMMAND_ID", "BAD_RESULT_PATH", "BAD_HASH", "BAD_APPROVAL_TIME", "AUTHORISATION_MISMATCH")}
    cards = spark.createDataFrame([("a", "o", "1"), ("b", "x", "1"), ("c", "o", "1"), ("c", "o", "2"), ("d", "o", "1"), ("e", "o", "1")], "name string, option string, content string")
    options = spark.createDataFrame([("o",)], "option string")
    existing = spark.createDataFrame([("d", "1"), ("e", "2")], "name string, content string")
    actions = sorted((r.name, r.action) for r in drafts.preflight(cards, options, existing).collect())
    assert actions == [("a", "CREATE"), ("b", "UNKNOWN_OPTION"), ("c", "DUPLICATE_IN_BATCH"), ("c", "DUPLICATE_IN_BATCH"), ("d", "RESUMABLE"), ("e", "DUPLICATE")]


def test_markers_bundles_and_prompts(spark):
    payloads = [{"id": "b", "page_number": 1, "bbox": [0, 0, 1, 1], "start_char": 5, "end_char": 6, "review_status": "AUTO_VERIFIED"}, {"id": "a", "page_number": 1, "bbox": [0, 0, 1, 1], "review_status": "UNRESOLVED"}, {"id": "c", "page_number": 2, "bbox": [0], "review_status": "x"}]
    rows = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")
    found = drafts.typed_markers(rows).orderBy("page_number", "position").collect()
    assert [(r.id, r.issue) for r in found] == [("a", None), ("b", None), ("c", "BAD_BBOX")]
    assert drafts.typed_markers(rows, F.array(F.lit(2))).count() == 1
    bound = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, sha256 string")
    assert {(r.path, r.change) for r in drafts.bundle_changes(bound, now).collect()} == {("b", "CHANGED"), ("c", "MISSING"), ("d", "UNBOUND")}
    marks = spark.createDataFrame([("m", "AUTO_VERIFIED", "e.png", 1), ("n", "NEEDS_REVIEW", "f.png", 2)], "id string, review_status string, evidence_image string, secret int")
    assert [tuple(r) for r in drafts.compact_markers(marks, ["id", "review_status", "evidence_image"]).collect()] == [("m", "AUTO_VERIFIED", None), ("n", "NEEDS_REVIEW", "f.png")]
    done = spark.createDataFrame([("s", "1", "h", 3), ("s", "1", "h", 5), ("s", "2", "h", 4)], "subject string, question string, source_sha256 string, done_page int")
    states = spark.createDataFrame([("s", "1", "h", "SYNC_STABLE"), ("s", "2", "old", "SYNC_STABLE")], "subject string, question string, source_sha256 string, status string")
    assert [r.done_page for r in drafts.completions(done, states, states.limit(0)).collect()] == [5]
    assert drafts.completions(done, states, states).count() == 0
    sections = spark.createDataFrame([("b", 2, "Two", "y"), ("b", 1, "One", "x")], "bundle string, position int, heading string, body string")
    assert drafts.prompt(sections).first().prompt == "## One\n\nx\n\n## Two\n\ny"
    names = spark.createDataFrame([("civil", True), ("civil", False), (" ", True)], "s string, n boolean").select(drafts.instruction_names(F.col("s"), F.col("n")))
    assert [r[0] for r in names.collect()] == [["common.md", "notes.md", "civil.md"], ["common.md", "civil.md"], None]
