"""Session construction and table loading."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("evidentia")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, by name."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their Python path or folder has it already."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    known = [Path(p).resolve() for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]]
    if app in _SHIPPED or root in known or any((p / "evidentia").is_dir() for p in known):
        return
    held = Path(SparkFiles.getRootDirectory(), "shipped")  # Spark deletes this folder with the session
    held.mkdir(exist_ok=True)
    with tempfile.TemporaryDirectory() as folder:
        tree = Path(folder, "tree")
        shutil.copytree(root / "evidentia", tree / "evidentia", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(held / "evidentia"), "zip", tree)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
