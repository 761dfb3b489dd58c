"""File observations as streams: changes, stability gates, question states, queues and command ledgers.

Per-key state lives in Spark's state store, tables are written from micro-batches and made
idempotent by anti joins with what is already there. Rows of a key are taken in the order of
their `seq` inside a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia.operators.state import INITIAL, TRANSITIONS

_EVENT = "path string, seq long, size long, mtime_ns long, sha256 string"


def _stateful(stream: DataFrame, key: list[str], output: str, state: str, step: Callable) -> DataFrame:
    """`step(state tuple or None, row) -> (state, output row or None)` over each key's rows in order of seq."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        out = []
        rows = pd.concat(list(parts)).sort_values("seq")
        for row in rows.itertuples(index=False):
            now, said = step(now, row)
            if said is not None:
                out.append((*keys, *said))
        if now is not None:
            held.update(now)
        names = [part.split()[0] for part in output.split(", ")]
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def changes(stream: DataFrame) -> DataFrame:
    """Observations (path, seq, present, size, mtime_ns, sha256) that differ from the last present one of their path.

    The first one is the baseline and says nothing; a missing file is ignored, and the same
    signature after a gap is no change.
    """

    def step(now, row):
        if not row.present:
            return now, None
        seen = (int(row.size), int(row.mtime_ns))
        said = (int(row.seq), *seen, row.sha256) if now is not None and tuple(now) != seen else None
        return seen, said

    return _stateful(stream, ["path"], _EVENT, "size long, mtime_ns long", step)


def stable(stream: DataFrame, needed: int = 3) -> DataFrame:
    """(path, seq, sha256, reason) once a file's size, time and hash were equal in `needed` observations in a row.

    Any change, or a missing file, starts the count again; an unbroken run is reported once.
    """
    if needed < 2:
        raise ValueError("needed must be 2 or more")

    def step(now, row):
        if not row.present:
            return (-1, -1, "", 0), (int(row.seq), None, "SOURCE_MISSING_DURING_SYNC") if now is not None and now[3] else None
        seen = (int(row.size), int(row.mtime_ns), row.sha256 or "")
        count = now[3] + 1 if now is not None and tuple(now[:3]) == seen else 1
        said = (int(row.seq), row.sha256, "STABLE_METADATA_AND_HASH") if count == needed else None
        return (*seen, count), said

    return _stateful(stream, ["path"], "path string, seq long, sha256 string, reason string", "size long, mtime_ns long, sha256 string, n int", step)


def questions(stream: DataFrame) -> DataFrame:
    """(subject, question, seq, wanted, state, accepted) for each move; a refused one leaves the state as it is."""

    def step(now, row):
        state = now[0] if now is not None else INITIAL
        good = row.to_status == state or row.to_status in TRANSITIONS[state]
        state = row.to_status if good else state
        return (state,), (int(row.seq), row.to_status, state, good)

    output = "subject string, question string, seq long, wanted string, state string, accepted boolean"
    return _stateful(stream, ["subject", "question"], output, "state string", step)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_once(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A micro-batch writer that adds rows whose key the table lacks; a batch written twice adds nothing.

    Each batch has its own folder, which a repeated batch replaces.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        if _exists(spark, path):
            held = spark.read.parquet(path)
            if "batch" in held.columns:
                rows = rows.join(held.where(F.col("batch") != batch_id).select(*key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def commands(path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch writer of command outcomes (command_id, sha256, seq, outcome).

    NEW commands are those neither in the ledger nor earlier in the batch; the same bytes again are
    REPLAY, other bytes under a known id COLLISION, and rows without id or hash MALFORMED.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from evidentia.operators.state import ledger

        spark = batch.sparkSession
        bad = F.col("command_id").isNull() | F.col("sha256").isNull()
        sound = batch.where(~bad).select("command_id", "sha256", F.col("seq").cast("long").alias("seq"))
        known = None
        if _exists(spark, path):
            known = spark.read.parquet(path).where((F.col("batch") != batch_id) & (F.col("outcome") == "NEW"))
        if known is not None:
            sound = sound.unionByName(known.select("command_id", "sha256", F.lit(-1).cast("long").alias("seq")))
        rows = ledger(sound).where("seq >= 0")
        malformed = batch.where(bad).select("command_id", "sha256", F.col("seq").cast("long").alias("seq"), F.lit("MALFORMED").alias("outcome"))
        rows.unionByName(malformed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all input there is, then stop."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
