"""Queues, state machines, ledgers, stability and caches in batch, over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import state
from evidentia.plans.registry import query
from evidentia.session import load

#: Event types as moves of a question, one question a user.
MOVES = {"signup": "IN_PROGRESS", "view": "DONE_DETECTED", "click": "SYNC_STABLE", "purchase": "PROCESSING", "error": "REVIEW_READY"}
_MOVE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in MOVES.items()) + " end"
_ALLOWED = " or ".join(f"(s.state = '{k}' and m.wanted in ({', '.join(repr(v) for v in vs)}))" for k, vs in state.TRANSITIONS.items() if vs)


def moves(events: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in MOVES.items() for x in kv])[F.col("event_type")]
    return events.select(F.col("user_id").alias("question"), F.col("event_id").alias("seq"), kind.alias("to_status"))


@query(
    f"""with recursive m as (select user_id, {_MOVE} as wanted, row_number() over (partition by user_id order by event_id) as k from events),
        s(user_id, k, state, applied, refused) as (
          select user_id, 0::bigint, 'IN_PROGRESS', 0::bigint, 0::bigint from (select distinct user_id from events)
          union all
          select m.user_id, m.k, case when s.state = m.wanted or {_ALLOWED} then m.wanted else s.state end,
                 s.applied + case when s.state = m.wanted or {_ALLOWED} then 1 else 0 end,
                 s.refused + case when s.state = m.wanted or {_ALLOWED} then 0 else 1 end
          from s join m on m.user_id = s.user_id and m.k = s.k + 1)
        select user_id as question, state, applied, refused from (select *, row_number() over (partition by user_id order by k desc) as r from s) where r = 1"""
)
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as moves of a state machine."""
    found = state.fold(moves(load(spark, sf_dir, "events")), "question", "seq", "to_status")
    return found.select("question", "state", *[F.col(c).cast("long").alias(c) for c in ("applied", "refused")])


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type = 'purchase') where n = 1")
def latest_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumns(
        {"status": F.when(F.col("event_type") == "purchase", "COMPLETED").otherwise("PENDING"), "pages": F.array("event_id"), "at": F.struct("ts", "event_id")}
    )
    return state.latest_completed(rows, "user_id", "at").select("user_id", "event_id", "value")


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def queue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, as insert-if-absent."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("question"), F.lit("sha").alias("source_sha256"), F.col("event_id").alias("seq"))
    return state.enqueue(rows).select(F.col("subject").alias("user_id"), F.col("question").alias("event_type"), F.col("seq").alias("event_id"))


@query("select user_id, min(event_id) as id, 1 as attempt_count, 'RUNNING' as status from events where event_type = 'click' group by 1")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's oldest pending work."""
    rows = load(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "PENDING").otherwise("COMPLETED").alias("status"), F.lit(0).alias("attempt_count"), F.lit("x").alias("last_error")
    )
    return state.claim(rows, "user_id").select("user_id", "id", "attempt_count", "status")


@query(
    """with o as (select user_id, event_id, event_type, case when event_type = lag(event_type) over w then 0 else 1 end as changed from events window w as (partition by user_id order by event_id)),
        i as (select *, sum(changed) over (partition by user_id order by event_id) as island from o)
        select event_id, run_length, run_length >= 3 as stable from (select event_id, row_number() over (partition by user_id, island order by event_id) as run_length from i)"""
)
def stability_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal observations of each user."""
    found = state.stability_runs(load(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"])
    return found.select("event_id", F.col("run_length").cast("long").alias("run_length"), "stable")


@query(
    """select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events where event_type <> 'error')
       where before is not null and before <> event_type"""
)
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that differ from the user's last one; errors count as a missing file."""
    rows = load(spark, sf_dir, "events").withColumn("present", F.col("event_type") != "error")
    return state.change_events(rows, "user_id", "event_id", ["event_type"]).select("event_id", "user_id", "event_type")


@query(
    """select event_id, case when n = 1 then 'NEW' when sha = first_sha then 'REPLAY' else 'COLLISION' end as outcome from
       (select event_id, sha256(event_type) as sha, first_value(sha256(event_type)) over w as first_sha, row_number() over w as n from events window w as (partition by user_id order by event_id))"""
)
def ledger_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as command ids, event types as their bytes."""
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("command_id"), F.sha2("event_type", 256).alias("sha256"), F.col("event_id").alias("seq"))
    return state.ledger(rows).select(F.col("seq").alias("event_id"), "outcome")


@query(
    """with c as (select distinct sha256(text) as k from documents where doc_id % 3 = 0 and doc_id % 9 <> 0)
       select count(*) as n_total, count(c.k) as n_reused, count(*) - count(c.k) as n_executed from documents d left join c on c.k = sha256(d.text)"""
)
def ocr_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents answered by a cache of a third of them, of which a third is corrupt."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("cache_key"), "text")
    cache = docs.where("doc_id % 3 = 0").select("cache_key", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    return state.reuse_counts(docs.drop("text"), cache)


@query("select o_orderkey, o_orderstatus = 'F' and o_orderkey % 5 <> 0 as resumable from orders")
def resume_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as completed steps; each fifth is wanted with another output."""
    orders = load(spark, sf_dir, "orders")
    shape = lambda output: orders.select(
        F.col("o_orderkey").alias("run_id"), F.lit("step").alias("step"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("input_hash"), F.lit("1").alias("version"), output.alias("output_hash"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"),
    )
    wanted = shape(F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise("same")).drop("status")
    return state.can_resume(shape(F.lit("same")), wanted).select(F.col("run_id").alias("o_orderkey"), "resumable")


@query(
    """select event_id, case when event_type = 'error' then false else ts + interval 180 second >= (select max(ts) from events) - interval 1 hour end as alive from events"""
)
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as heartbeats without a lease, seen an hour before the last."""
    events = load(spark, sf_dir, "events")
    now = events.agg((F.max("ts") - F.expr("interval 1 hour")).alias("now"))
    rows = events.select("event_id", F.col("ts").alias("beat_at"), F.lit(None).cast("timestamp").alias("lease_until"), F.when(F.col("event_type") == "error", "FAILED").alias("status"))
    return state.alive(rows.join(F.broadcast(now), how="cross"), F.col("now")).select("event_id", "alive")  # one row of now


@query(
    """select n_name as nation, o_orderpriority as priority, count(*) as n_orders, sum(round(l_extendedprice * (1 - l_discount), 4)::decimal(20, 4))::double as revenue
       from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where l_returnflag = 'R' group by 1, 2"""
)
def returned_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-way join with filters and columns pushed to the scans."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == customers.c_custkey)
    rows = rows.join(nations, F.col("c_nationkey") == nations.n_nationkey)
    exact = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(20,4)")  # sums alike in any order
    revenue = F.sum(exact).cast("double")
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n_orders"), revenue.alias("revenue"))
