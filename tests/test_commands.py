"""Commands that work on tables, and finalising a run from what it kept."""

import pytest
from test_evidence import BOX, evidence

from evidentia.__main__ import main
from evidentia.plans import ingest


def written(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).write.parquet(path)
    return path


@pytest.fixture
def kept(spark, tmp_path):
    table = spark.createDataFrame([("d", 1, 595.0, 842.0, 0, "Body text. " * 50, 0.0, 0.0), ("d", 2, 595.0, 842.0, 0, "", 1.0, 1.0)], "document string, page_number int, width double, height double, rotation int, native_text string, image_coverage double, largest_image_coverage double")
    rows = [("d", 2, 0, "x", "full_page", "completed", None, BOX, None, None, "read text", 0.9, None)]
    marks = spark.createDataFrame([("d", 1, "m1", "yellow", "NEEDS_REVIEW")], "document string, page_number int, id string, color string, review_status string")
    root = f"file://{tmp_path}/runs"
    ingest.ingest(ingest.Run(spark, root, "r1"), table, evidence(spark, rows), marks, "h1")
    return root, marks


def test_finalize_reuses_what_is_sound(spark, kept, tmp_path):
    root, marks = kept
    run = ingest.Run(spark, root, "r1")
    assert {r.page_number: r.canonical_text for r in ingest.finalize(run, marks).collect()}[2] == "read text"
    assert len(run.reused) == 6  # all after the evidence
    spark.read.parquet(f"{root}/r1/canonical").limit(1).collect()
    spark.createDataFrame([("d", 9)], "document string, page_number int").write.mode("overwrite").parquet(f"{root}/r1/canonical")
    again = ingest.Run(spark, root, "r1")
    assert ingest.finalize(again, marks).count() == 2 and len(again.reused) == 5  # the altered table is made anew
    marks.write.parquet(f"{tmp_path}/marks")
    main(["finalize", "--root", root, "--run", "r1", "--markers", f"{tmp_path}/marks", "--out", f"{tmp_path}/pack"])
    assert "## PDF page 2" in spark.read.parquet(f"{tmp_path}/pack").first().markdown


def test_finalize_refuses_altered_or_missing_evidence(spark, kept):
    root, marks = kept
    with pytest.raises(LookupError):
        ingest.finalize(ingest.Run(spark, root, "other"), marks)
    held = spark.read.parquet(f"{root}/r1/evidence").collect()
    schema = spark.read.parquet(f"{root}/r1/evidence").schema
    spark.createDataFrame([held[0]] * 2, schema).write.mode("overwrite").parquet(f"{root}/r1/evidence")
    with pytest.raises(ValueError):
        ingest.finalize(ingest.Run(spark, root, "r1"), marks)


def test_table_commands(spark, tmp_path):
    at = f"{tmp_path}/"
    responses = written(spark, [("{}", True, True, True), ("[", True, True, True)], "raw string, schema_ok boolean, provenance_ok boolean, gates_ok boolean", at + "responses")
    main(["draft", "--responses", responses, "--out", at + "accepted"])
    assert sorted(r.stage for r in spark.read.parquet(at + "accepted").collect()) == ["ACCEPTED", "INVALID_JSON"]
    members = written(spark, [("p", "a", "x"), ("q", "a", "y")], "packet string, member string, content string", at + "members")
    published = written(spark, [("p-0.zip", "other")], "name string, sha256 string", at + "published")
    main(["packet", "--members", members, "--published", published, "--out", at + "packets"])
    assert {r.name: r.action for r in spark.read.parquet(at + "packets").collect()} == {"p-0.zip": "REFUSE", "q-0.zip": "PUBLISH"}
    commands = written(spark, [("c 1", "x/r", "z", "2024-01-01", "?", True)], "command_id string, result_file string, result_sha256 string, approved_at string, action string, registration_authorized boolean", at + "commands")
    main(["bridge", "--commands", commands, "--folder", "results", "--out", at + "issues"])
    assert spark.read.parquet(at + "issues").count() == 6
    images = written(spark, [("d", 1, "rendered", BOX, [1.0, 2.0], 100.0, 100.0)], "document string, page_number int, method string, bbox array<double>, signature array<double>, page_width double, page_height double", at + "images")
    template = written(spark, [([1.0, 2.0], 1.0)], "signature array<double>, aspect double", at + "template")
    main(["mark", "--images", images, "--template", template, "--out", at + "stamps"])
    assert spark.read.parquet(at + "stamps").first().score == 1.0
