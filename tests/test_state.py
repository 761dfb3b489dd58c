"""Queue, machine, ledger and streams."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import state
from evidentia.streaming import changes

QUEUE = "id int, status string, attempt_count int, last_error string"


def test_queue_attempts(spark):
    queue = spark.createDataFrame([(1, "COMPLETED", 1, None), (2, "PENDING", 2, "e"), (3, "PENDING", 0, None)], QUEUE)
    claimed = state.claim(queue)
    row = claimed.first()
    assert (row.id, row.status, row.attempt_count, row.last_error) == (2, "RUNNING", 3, None)
    outcome = spark.createDataFrame([(2, False, True, "again")], "id int, ok boolean, retryable boolean, error string")
    assert state.settle(claimed, outcome).first().status == "FAILED"
    early = claimed.withColumn("attempt_count", F.lit(1))
    assert state.settle(early, outcome).first().status == "PENDING"
    assert state.recover(state.upsert(queue, claimed, ["id"])).where("status = 'PENDING'").count() == 2


def test_enqueue_is_idempotent(spark):
    items = spark.createDataFrame([("s", "q", "h", 1), ("s", "q", "h", 2), ("s", "r", "h", 3)], "subject string, question string, source_sha256 string, seq int")
    first = state.enqueue(items)
    assert sorted(r.seq for r in first.collect()) == [1, 3]
    assert state.enqueue(items, first).count() == 0


def test_machine(spark):
    moves = ["DONE_DETECTED", "PROCESSING", "SYNC_STABLE", "PROCESSING", "REVIEW_READY", "APPROVED", "IN_PROGRESS", "APPROVED"]
    rows = spark.createDataFrame([("q", i, m) for i, m in enumerate(moves)], "k string, seq int, m string")
    found = state.fold(rows, "k", "seq", "m").first()
    assert (found.state, found.applied, found.refused) == ("APPROVED", 6, 2)


def test_cache_and_resume(spark):
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    cache = spark.createDataFrame([("a", "x"), ("b", None)], "cache_key string, text string")
    hit, left = state.with_cache(targets, cache)
    assert [r.cache_key for r in hit.collect()] == ["a"] and sorted(r.cache_key for r in left.collect()) == ["b", "c"]
    assert tuple(state.reuse_counts(targets, cache).first()) == (3, 1, 2)


@pytest.fixture
def stream(spark, tmp_path):
    """Batches of rows, a file each, as a stream of one file at a time."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
        return reader.parquet(f"{tmp_path}/in"), f"{tmp_path}"

    return make


SEEN = "path string, seq long, present boolean, size long, mtime_ns long, sha256 string"


def run(spark, found, base, write):
    changes.drain(found, f"{base}/checkpoint", write(f"{base}/out"))
    return spark.read.parquet(f"{base}/out").collect()


def kept(path):
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def test_changes_over_batches(spark, stream):
    rows, base = stream([[("f", 1, True, 5, 1, "a"), ("f", 2, True, 5, 1, "a")], [("f", 3, False, None, None, None), ("f", 4, True, 5, 1, "a"), ("f", 5, True, 6, 1, "b")]], SEEN)
    assert [(r.seq, r.size) for r in run(spark, changes.changes(rows), base, kept)] == [(5, 6)]


def test_stability_over_batches(spark, stream):
    equal = lambda *seqs: [("f", s, True, 5, 1, "a") for s in seqs]
    rows, base = stream([equal(1, 2), [("f", 3, True, 6, 1, "b")], equal(4, 5), equal(6, 7), [("f", 8, False, None, None, None)]], SEEN)
    found = sorted((r.seq, r.reason) for r in run(spark, changes.stable(rows), base, kept))
    assert found == [(6, "STABLE_METADATA_AND_HASH"), (8, "SOURCE_MISSING_DURING_SYNC")]


def test_questions_over_batches(spark, stream):
    schema = "subject string, question string, seq long, to_status string"
    rows, base = stream([[("s", "q", 1, "DONE_DETECTED")], [("s", "q", 2, "APPROVED"), ("s", "q", 3, "SYNC_STABLE")]], schema)
    found = sorted((r.seq, r.state, r.accepted) for r in run(spark, changes.questions(rows), base, kept))
    assert found == [(1, "DONE_DETECTED", True), (2, "DONE_DETECTED", False), (3, "SYNC_STABLE", True)]


def test_ledger_over_batches(spark, stream):
    schema = "command_id string, sha256 string, seq long"
    rows, base = stream([[("c", "h", 1), (None, "h", 2)], [("c", "h", 3), ("c", "other", 4), ("d", "h", 5)]], schema)
    found = {r.seq: r.outcome for r in run(spark, rows, base, changes.commands)}
    assert found == {1: "NEW", 2: "MALFORMED", 3: "REPLAY", 4: "COLLISION", 5: "NEW"}


def test_append_once_over_repeated_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    write = changes.append_once(str(tmp_path / "t"), ["k"])
    for batch, n in ((rows, 0), (rows, 1), (rows, 1)):
        write(batch, n)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
