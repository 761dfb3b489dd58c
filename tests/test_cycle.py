"""Stamps, incremental cycles and commands."""

from evidentia import __main__ as command
from evidentia.operators import pages, stamps
from evidentia.plans import cycle


def test_stamps(spark):
    schema = "document string, page_number int, method string, bbox array<double>, signature array<double>, page_width double, page_height double"
    good, low, top = [60.0, 80.0, 90.0, 91.0], [60.0, 80.0, 90.0, 110.0], [60.0, 10.0, 90.0, 21.0]
    mark, noise = [0.0, 255.0, 0.0, 255.0], [255.0, 0.0, 255.0, 0.0]
    near = [0.0, 255.0, 0.0, 105.0]
    rows = [("d", 1, "embedded", good, mark), ("d", 2, "embedded", low, mark), ("d", 3, "embedded", top, mark), ("d", 4, "embedded", good, noise), ("d", 5, "rendered", good, near), ("d", 6, "embedded", good, near), ("d", 6, "rendered", top, near), ("d", 1, "rendered", good, mark)]
    images = spark.createDataFrame([(*r, 100.0, 100.0) for r in rows], schema)
    template = spark.createDataFrame([(mark, 600 / 220)], "signature array<double>, aspect double")
    assert {r.page_number: r.method for r in stamps.detect(images, template).collect()} == {1: "embedded", 5: "rendered", 6: "rendered"}


def test_cycle(spark):
    schema = "document string, page_number int, width double, height double, rotation int, native_text string"
    version = lambda texts: pages.identity(spark.createDataFrame([("d", n, 1.0, 1.0, 0, t) for n, t in enumerate(texts, 1)], schema))
    old = version(["第1問 次の", "answer one", "第2問 次の", "draft"])
    new = version(["第1問 次の", "answer one", "第2問 次の", "answer two"])
    done = spark.createDataFrame([("d", 2), ("d", 4)], "document string, page_number int")
    items = spark.createDataFrame([("d", "q1", [1, 2])], "document string, item string, pages array<int>")
    states = spark.createDataFrame([("s", "2", "h", "SYNC_STABLE"), ("s", "1", "h", "SYNC_STABLE")], "subject string, question string, source_sha256 string, status string")
    run = lambda before, marks=done, queue=states.limit(0): cycle.cycle(before, new, marks, items, states, queue, "s", "h")
    assert run(None)[0] == "INITIAL_BASELINE_ESTABLISHED"
    assert run(new)[0] == "NO_RELEVANT_PAGE_CHANGES" and run(old, done.limit(1))[0] == "NO_RELEVANT_PAGE_CHANGES"
    reason, work = run(old)
    assert reason == "PROCESSED_STABLE_UPDATE"
    assert [(r.question, r.done_page, r.start_page) for r in work.collect()] == [("2", 4, 3)]
    assert run(old, done, states)[1].count() == 0
    reasons = [cycle.startup_reason(*a) for a in ((False, False, None, "h", True), (True, True, "h", "h", True), (True, False, "h", "h", True), (True, True, "g", "h", True), (True, True, "h", "h", False))]
    assert reasons == ["INITIAL_BASELINE_ESTABLISHED", "PERSISTED_BASELINE_UNCHANGED", "PERSISTED_BASELINE_REESTABLISHED", "PROCESSED_STABLE_UPDATE", "SOURCE_CHANGED_AFTER_STABILITY_CHECK"]


def test_commands(spark, tmp_path, capsys):
    command.main(["doctor"])
    assert "queries" in capsys.readouterr().out
    out = str(tmp_path / "q")
    command.main(["query", "--name", "queue_claim", "--data", "/root/testdata/sf0.001", "--out", out])
    assert spark.read.parquet(out).count() > 0
    rows = spark.createDataFrame([("f", s, True, 1, 1, "h") for s in range(4)], "path string, seq long, present boolean, size long, mtime_ns long, sha256 string")
    rows.write.parquet(str(tmp_path / "obs"))
    command.main(["watch", "--observations", str(tmp_path / "obs"), "--checkpoint", str(tmp_path / "c"), "--out", str(tmp_path / "w")])
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "w")).collect()] == [2]
