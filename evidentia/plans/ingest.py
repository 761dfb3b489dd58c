"""The batch plan: pages to canonical documents, step by step, each step resumable.

A step's table is kept under the run's folder with a row in the step ledger; a step runs again
only if its inputs, version or output differ from a completed one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import markers, pages, reconciliation, review

VERSION = "1"
LEDGER = "run_id string, step string, status string, input_hash string, version string, output_hash string, retry_count int, updated_at timestamp"


def table_hash(rows: DataFrame) -> str:
    """Digest of a table's rows, whatever their order: their number and the sum of their hashes."""
    found = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{found.n}:{found.h}"


class Run:
    """Steps of one run, with their tables and ledger below `root`."""

    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark, self.root, self.run_id = spark, f"{root}/{run_id}", run_id
        self.ledger = f"{root}/_ledger"
        self.reused: list[str] = []

    def _rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.ledger)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.ledger)

    def _note(self, step: str, status: str, input_hash: str, retries: int, output_hash: str | None = None) -> None:
        row = [(self.run_id, step, status, input_hash, VERSION, output_hash, retries)]
        rows = self.spark.createDataFrame(row, LEDGER.rsplit(",", 1)[0]).withColumn("updated_at", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(self.ledger)

    def _last(self, name: str):
        rows = self._rows().where((F.col("run_id") == self.run_id) & (F.col("step") == name))
        return rows.agg(F.max_by(F.struct("status", "input_hash", "version", "output_hash"), "updated_at").alias("s"), F.count_if(F.col("status") == "RUNNING").alias("n")).first()

    def _sound(self, name: str, output_hash: str | None) -> bool:
        """Whether a step's table is there as the ledger knows it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return there and table_hash(self.spark.read.parquet(f"{self.root}/{name}")) == output_hash

    def step(self, name: str, input_hash: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The step's table, computed unless it was completed with the same input and version and is as it was left."""
        last, path = self._last(name), f"{self.root}/{name}"
        if last.s and (last.s.status, last.s.input_hash, last.s.version) == ("COMPLETED", input_hash, VERSION) and self._sound(name, last.s.output_hash):
            self.reused.append(name)
            return self.spark.read.parquet(path)
        self._note(name, "RUNNING", input_hash, last.n)
        try:
            compute().write.mode("overwrite").parquet(path)
        except Exception:
            self._note(name, "FAILED", input_hash, last.n)
            raise
        done = self.spark.read.parquet(path)
        self._note(name, "COMPLETED", input_hash, last.n, table_hash(done))
        return done

    def kept(self, name: str) -> tuple[DataFrame, str]:
        """A completed step's table and input hash; an error if there is none or the table isn't what the ledger says."""
        last = self._last(name)
        if not last.s or (last.s.status, last.s.version) != ("COMPLETED", VERSION):
            raise LookupError(f"run {self.run_id} has not completed {name}")
        if not self._sound(name, last.s.output_hash):
            raise ValueError(f"the table of {name} in run {self.run_id} is not the one that was written")
        return self.spark.read.parquet(f"{self.root}/{name}"), last.s.input_hash


def ingest(run: Run, page_table: DataFrame, evidence: DataFrame, logical: DataFrame, input_hash: str) -> DataFrame:
    """Canonical pages (with their text, supplements, markers and task) of a run.

    `page_table` as in operators.pages, `evidence` as in operators.reconciliation, `logical`
    markers (document, page_number, id, color, review_status).
    """
    inspected = run.step("inspection", input_hash, lambda: pages.assessed(page_table))
    seen = run.step("evidence", input_hash, lambda: reconciliation.numbered(evidence))
    return _from_evidence(run, inspected, seen, logical, input_hash)


def finalize(run: Run, logical: DataFrame) -> DataFrame:
    """Canonical pages of a run whose inspection and evidence were completed, without recognising anything again.

    Both must be what the ledger says they are; later steps that are sound are reused.
    """
    inspected, input_hash = run.kept("inspection")
    seen, of_evidence = run.kept("evidence")
    if of_evidence != input_hash:
        raise ValueError(f"inspection and evidence of run {run.run_id} are of different inputs")
    return _from_evidence(run, inspected, seen, logical, input_hash)


def _from_evidence(run: Run, inspected: DataFrame, evidence: DataFrame, logical: DataFrame, input_hash: str) -> DataFrame:
    records = run.step("reconciliation", input_hash, lambda: reconciliation.reconcile(evidence))
    decided = run.step("repair_decisions", input_hash, lambda: reconciliation.decisions(records, inspected))
    repaired, checked = reconciliation.repair(inspected, decided)
    checked = run.step("repair_checked", input_hash, lambda: checked)
    repaired = repaired.join(reconciliation.page_ocr(records), ["document", "page_number"], "left")
    texts = run.step("canonical_text", input_hash, lambda: markers.canonical_text(repaired))
    tasks = run.step("review", input_hash, lambda: review.page_tasks(review.issues(checked, records, logical)))
    return run.step("canonical", input_hash, lambda: review.canonical(texts, tasks, reconciliation.supplements(records), logical))
