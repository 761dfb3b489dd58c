"""Recognition with an injected engine: reuse, invalidation, failures."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from evidentia.operators import recognition, routing

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Upper:
    name = "upper"

    def __init__(self, dpi=300):
        self.settings = {"dpi": dpi, "model": "m1"}

    def recognise(self, image):
        if image == b"bad":
            raise RuntimeError("no text")
        return [(t.upper(), 0.5, None) for t in image.decode().split("|") if t]


def targets(spark, rows, engine):
    docs = spark.createDataFrame(rows, "target_id string, page string, image binary")
    key = routing.target_key(F.col("page"), F.lit("full_page"), F.array(F.lit(0.0)), F.lit(300), F.lit(0.0), recognition.image_key(F.col("image")), F.lit(recognition.backend_signature(engine)))
    return docs.withColumn("cache_key", key)


ROWS = [("a", "p1", b"one|two"), ("b", "p1", b"one|two"), ("c", "p2", b"bad"), ("d", "p3", None), ("e", "p4", b"")]


def test_answers_and_failures(spark):
    found = {r.target_id: r for r in recognition.recognise(targets(spark, ROWS, Upper()), Upper).collect()}
    assert (found["a"].status, found["a"].text, found["a"].confidence, len(found["a"].lines)) == ("completed", "ONE\nTWO", 0.5, 2)
    assert (found["c"].status, found["c"].error, found["c"].text) == ("failed", "RuntimeError: no text", None)
    assert found["d"].error == "ValueError: no image" and (found["e"].status, found["e"].text) == ("completed", None)
    assert "image" not in found["a"].asDict()
    none = recognition.recognise(targets(spark, ROWS, Upper()), None).collect()
    assert {r.status for r in none} == {"not_executed_no_backend"}


def test_cache_is_keyed_by_image_page_and_engine(spark):
    first = targets(spark, ROWS, Upper())
    answers, additions = recognition.read_through(first, recognition.recognise(first.limit(0), None).select("cache_key", "text", "confidence", "lines"), Upper)
    assert {r.target_id: r.reused for r in answers.collect()} == dict.fromkeys("abcde", False)
    kept = spark.createDataFrame(additions.collect(), additions.schema)
    assert kept.count() == 1  # two targets of one key; what failed or is empty isn't kept
    again, _ = recognition.read_through(first, kept, Upper)
    assert {r.target_id: r.reused for r in again.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    other, _ = recognition.read_through(targets(spark, ROWS, Upper(600)), kept, lambda: Upper(600))
    assert not any(r.reused for r in other.collect())
    moved, _ = recognition.read_through(targets(spark, [("a", "p9", b"one|two"), ("b", "p1", b"one|twos")], Upper()), kept, Upper)
    assert not any(r.reused for r in moved.collect())
    corrupt, _ = recognition.read_through(first, kept.withColumn("text", F.lit("else")), Upper)
    assert not any(r.reused for r in corrupt.collect())
