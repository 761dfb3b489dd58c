"""Structured Streaming queries: the driver's events read as a stream to its end, results read back from their sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.plans.queries_state import moves
from evidentia.plans.registry import ORACLE_SQL, query
from evidentia.session import load
from evidentia.staging import root
from evidentia.streaming import changes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema, name = load(spark, sf_dir, "events").schema, f"{sf_dir}/events.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    single = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if single else "*.parquet")
    return reader.parquet(sf_dir if single else name)


def _drained(stream: DataFrame, writer: Callable) -> DataFrame:
    base = f"{root(stream.sparkSession)}/stream-{uuid.uuid4().hex[:12]}"
    changes.drain(stream, f"{base}/checkpoint", writer(f"{base}/table"))
    return stream.sparkSession.read.parquet(f"{base}/table")


def _kept(path: str) -> Callable:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files whose event types are their content; errors as a missing file."""
    present = F.col("event_type") != "error"
    return _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), present.alias("present"), F.length("event_type").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), F.col("event_type").alias("sha256")
    )


@query(
    """with p as (select event_id, user_id, length(event_type) as size from events where event_type <> 'error')
       select user_id::varchar as path, event_id as seq, size from (select *, lag(size) over (partition by user_id order by event_id) as before from p) where before is not null and before <> size"""
)
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(changes.changes(_observed(spark, sf_dir)), _kept).select("path", "seq", "size")


@query(
    """with o as (select user_id, event_id, event_type, case when event_type = lag(event_type) over w then 0 else 1 end as changed from events window w as (partition by user_id order by event_id)),
        i as (select *, sum(changed) over (partition by user_id order by event_id) as island from o),
        n as (select *, row_number() over (partition by user_id, island order by event_id) as k from i)
        select user_id::varchar as path, event_id as seq from n where k = 3 and event_type <> 'error'"""
)
def stream_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _drained(changes.stable(_observed(spark, sf_dir)), _kept)
    return found.where("reason = 'STABLE_METADATA_AND_HASH'").select("path", "seq")


@query(ORACLE_SQL["state_fold"])
def stream_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over the stream; its outcome equals that of the batch fold."""
    rows = moves(_events(spark, sf_dir)).withColumns({"subject": F.lit("s"), "question": F.col("question").cast("string")})
    found = _drained(changes.questions(rows), _kept).groupBy("question")
    return found.agg(F.max_by("state", "seq").alias("state"), F.count_if("accepted").alias("applied"), F.count_if(~F.col("accepted")).alias("refused")).withColumn("question", F.col("question").cast("long"))


@query("select distinct user_id, event_type from events")
def stream_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent into a queue table from micro-batches."""
    return _drained(_events(spark, sf_dir).select("user_id", "event_type"), lambda path: changes.append_once(path, ["user_id", "event_type"])).select("user_id", "event_type")


@query(ORACLE_SQL["ledger_outcomes"])
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command outcomes from micro-batches against the ledger so far."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("command_id"), F.sha2("event_type", 256).alias("sha256"), F.col("event_id").alias("seq"))
    return _drained(rows, changes.commands).select(F.col("seq").alias("event_id"), "outcome")
