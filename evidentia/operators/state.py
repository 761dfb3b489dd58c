"""Work state as tables: queue, state machine fold, ledger, step resumption, caches. Batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Allowed moves of a question; staying is always allowed.
TRANSITIONS = {
    "IN_PROGRESS": ("DONE_DETECTED",),
    "DONE_DETECTED": ("IN_PROGRESS", "SYNC_STABLE"),
    "SYNC_STABLE": ("IN_PROGRESS", "PROCESSING"),
    "PROCESSING": ("IN_PROGRESS", "SYNC_STABLE", "REVIEW_READY"),
    "REVIEW_READY": ("IN_PROGRESS", "APPROVED"),
    "APPROVED": (),
}
INITIAL = "IN_PROGRESS"
MAX_ATTEMPTS = 3


def allowed(old: Column, new: Column) -> Column:
    """Whether a question may move from one state to another."""
    moves = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce((old == new) | F.array_contains(F.element_at(moves, old), new), F.lit(False))


def fold(moves: DataFrame, key: str, order: str, to: str) -> DataFrame:
    """(key, state, applied, refused): each key's moves applied in order from the initial state; refused ones change nothing."""
    listed = moves.where(F.col(to).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, to))).alias("moves"))
    start = F.struct(F.lit(INITIAL).alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def step(s: Column, m: Column) -> Column:
        good = allowed(s["state"], m[to])
        return F.struct(
            F.when(good, m[to]).otherwise(s["state"]).alias("state"),
            (s["applied"] + good.cast("int")).alias("applied"),
            (s["refused"] + (~good).cast("int")).alias("refused"),
        )

    return listed.select(key, F.aggregate("moves", start, step).alias("s")).select(key, "s.*")


def enqueue(items: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """Items that the queue lacks, each (subject, question, source_sha256) once, the first by seq."""
    key = ["subject", "question", "source_sha256"]
    nth = F.row_number().over(W.partitionBy(*key).orderBy("seq"))
    fresh = items.withColumn("nth", nth).where("nth = 1").drop("nth")
    return fresh if queue is None else fresh.join(queue.select(*key), key, "left_anti")


def claim(queue: DataFrame, by: str | None = None) -> DataFrame:
    """The oldest pending row (of each `by`), RUNNING with one more attempt and no error."""
    pending = queue.where("status = 'PENDING'")
    if by is None:
        first = pending.orderBy("id").limit(1)
    else:
        first = pending.withColumn("nth", F.row_number().over(W.partitionBy(by).orderBy("id"))).where("nth = 1").drop("nth")
    return first.withColumns(
        {"status": F.lit("RUNNING"), "attempt_count": F.col("attempt_count") + 1, "last_error": F.lit(None).cast("string")}
    )


def settle(running: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Running rows after (id, ok, retryable, error): COMPLETED, back to PENDING while attempts last, or FAILED."""
    rows = running.join(outcomes, "id", "left")
    again = F.coalesce("retryable", F.lit(False)) & (F.col("attempt_count") < MAX_ATTEMPTS)
    status = F.when(F.col("ok"), "COMPLETED").when(F.col("ok").isNull(), F.col("status")).when(again, "PENDING").otherwise("FAILED")
    return rows.withColumns({"status": status, "last_error": F.when(~F.col("ok"), F.col("error")).otherwise(F.col("last_error"))}).drop("ok", "retryable", "error")


def recover(queue: DataFrame) -> DataFrame:
    """Rows that were running when work stopped are pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "RUNNING", "PENDING").otherwise(F.col("status")))


def latest_completed(queue: DataFrame, key: str = "question", order: str = "id") -> DataFrame:
    """The last completed row of each key among those that name pages."""
    done = queue.where((F.col("status") == "COMPLETED") & (F.size("pages") > 0))
    return done.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("nth = 1").drop("nth")


def ledger(commands: DataFrame) -> DataFrame:
    """Each command with its outcome: NEW the first time, REPLAY for the same bytes again, COLLISION for other bytes under a used id."""
    by = W.partitionBy("command_id").orderBy("seq")
    first = F.first("sha256").over(by)
    outcome = F.when(F.row_number().over(by) == 1, "NEW").when(F.col("sha256") == first, "REPLAY").otherwise("COLLISION")
    return commands.withColumn("outcome", outcome)


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """`table` with rows of `changes` in place of those of the same key, and added."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes)


def can_resume(steps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted steps (run_id, step, input_hash, version, output_hash) with resumable: completed before with all the same."""
    key = ["run_id", "step", "input_hash", "version", "output_hash"]
    done = steps.where("status = 'COMPLETED'").select(*key).distinct().withColumn("resumable", F.lit(True))
    return wanted.join(done, key, "left").withColumn("resumable", F.coalesce("resumable", F.lit(False)))


def stability_runs(observations: DataFrame, by: str, order: str, values: list[str], needed: int = 3) -> DataFrame:
    """Observations with run_length, how many equal ones in a row end here, and stable from `needed` on."""
    ordered = W.partitionBy(by).orderBy(order)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(ordered))
    first = F.row_number().over(ordered) == 1
    rows = observations.withColumn("island", F.sum((first | ~same).cast("int")).over(ordered))
    nth = F.row_number().over(W.partitionBy(by, "island").orderBy(order))
    return rows.withColumn("run_length", nth).withColumn("stable", nth >= needed).drop("island")


def change_events(observations: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """Observations (present or not) that differ from the last present one; the first present one is the silent baseline."""
    seen = observations.where("present")
    ordered = W.partitionBy(by).orderBy(order)
    last = F.lag(F.struct(*values)).over(ordered)
    return seen.withColumn("before", last).where(F.col("before").isNotNull() & (F.col("before") != F.struct(*values))).drop("before")


def with_cache(targets: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Targets answered by the cache, and those left to execute. Cache rows without text are corrupt and don't count."""
    good = cache.where("text is not null").dropDuplicates([key])
    return targets.join(good.select(key, "text"), key), targets.join(good.select(key), key, "left_anti")


def reuse_counts(targets: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    good = cache.where("text is not null").select(key).distinct().withColumn("hit", F.lit(True))
    return targets.join(good, key, "left").agg(
        F.count("*").alias("n_total"), F.count_if(F.col("hit")).alias("n_reused"), F.count_if(F.col("hit").isNull()).alias("n_executed")
    )


def alive(heartbeats: DataFrame, now: Column, fallback_seconds: int = 180) -> DataFrame:
    """Heartbeats with alive: not in a final status, and the lease (or fallback after the beat) not over."""
    until = F.coalesce("lease_until", F.col("beat_at") + F.make_dt_interval(secs=F.lit(fallback_seconds)))
    final = F.coalesce("status", F.lit("")).isin("STOPPED", "FAILED", "EXITED")
    return heartbeats.withColumn("alive", ~final & F.coalesce(until >= now, F.lit(False)))
