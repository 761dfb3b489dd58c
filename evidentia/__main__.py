"""Commands: python -m evidentia COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evidentia.operators import alignment, drafts, pages, retrieval, review, stamps
from evidentia.plans import catalogue, ingest
from evidentia.session import TABLES, local_session
from evidentia.sources import sinks
from evidentia.streaming import changes


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evidentia")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, flags in {
        "doctor": (),
        "inspect": ("--pages", "--out"),
        "diff": ("--old", "--new", "--out"),
        "search": ("--queries", "--notes", "--out"),
        "query": ("--name", "--data", "--out"),
        "watch": ("--observations", "--checkpoint", "--out"),
        "mark": ("--images", "--template", "--out"),
        "finalize": ("--root", "--run", "--markers", "--out"),
        "draft": ("--responses", "--out"),
        "packet": ("--members", "--published", "--out"),
        "bridge": ("--commands", "--folder", "--out"),
    }.items():
        command = commands.add_parser(name)
        for flag in flags:
            command.add_argument(flag, required=True)
    given = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or local_session()
    if given.command == "doctor":
        print(f"Spark {spark.version}, {len(catalogue.QUERIES)} queries over {len(TABLES)} tables")
    elif given.command == "inspect":
        pages.assessed(spark.read.parquet(given.pages)).write.mode("overwrite").parquet(given.out)
    elif given.command == "diff":
        old, new = (pages.identity(spark.read.parquet(p)) for p in (given.old, given.new))
        found = alignment.align(old, new)
        found.write.mode("overwrite").parquet(given.out)
        spark.read.parquet(given.out).groupBy("classification").agg(F.count("*").alias("pages")).show()
    elif given.command == "search":
        found = retrieval.search(spark.read.parquet(given.queries), spark.read.parquet(given.notes))
        found.write.mode("overwrite").parquet(given.out)
    elif given.command == "query":
        catalogue.QUERIES[given.name](spark, given.data).write.mode("overwrite").parquet(given.out)
    elif given.command == "watch":
        schema = "path string, seq long, present boolean, size long, mtime_ns long, sha256 string"
        stream = spark.readStream.schema(schema).parquet(given.observations)
        changes.drain(changes.stable(stream), given.checkpoint, changes.append_once(given.out, ["path", "seq"]))
    elif given.command == "mark":
        stamps.detect(spark.read.parquet(given.images), spark.read.parquet(given.template)).write.mode("overwrite").parquet(given.out)
    elif given.command == "finalize":
        found = ingest.finalize(ingest.Run(spark, given.root, given.run), spark.read.parquet(given.markers))
        review.handoff(found).write.mode("overwrite").parquet(given.out)
    elif given.command == "draft":
        drafts.acceptance(spark.read.parquet(given.responses)).write.mode("overwrite").parquet(given.out)
    elif given.command == "packet":
        built = sinks.packets(spark.read.parquet(given.members))
        name = F.format_string("%s-%d.zip", "packet", "part").alias("name")
        ready = sinks.publication(built.select(name, F.col("content_sha256").alias("sha256"), "content"), spark.read.parquet(given.published))
        ready.write.mode("overwrite").parquet(given.out)
    elif given.command == "bridge":
        found = drafts.command_issues(spark.read.parquet(given.commands), given.folder)
        found.write.mode("overwrite").parquet(given.out)


if __name__ == "__main__":
    main()
