"""Sinks: packets as ZIP bytes, idempotent publication, orphans, cards and receipts."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

#: Bytes of members after which a packet goes on in another part.
PART_BYTES = 64 << 20


def packets(members: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """(packet, part, content, content_sha256): ZIPs of each packet's members (packet, member, content), byte for byte repeatable.

    Members go in order of their names into parts of about `most` bytes, a larger member alone, so that
    no task holds more than a part, however large a packet is. A packet of under `most` bytes has one part.
    """
    rows = members.select("packet", "member", F.col("content").cast("binary").alias("content"))
    before = F.sum(F.octet_length("content").cast("long")).over(Window.partitionBy("packet").orderBy("member").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / most).cast("int"))

    def build(rows: pa.Table) -> pa.Table:
        data, members, contents = io.BytesIO(), rows["member"].to_pylist(), rows["content"]
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            # Members of one name go by their content, which is only then compared.
            alike = len(set(members)) < len(members)
            order = sorted(range(len(members)), key=lambda i: (members[i], contents[i].as_py()) if alike else members[i])
            for i in order:
                z.writestr(zipfile.ZipInfo(members[i], (1980, 1, 1, 0, 0, 0)), contents[i].as_py(), zipfile.ZIP_DEFLATED)
        built = pa.array([data.getbuffer()], pa.binary())
        return pa.table({"packet": rows["packet"][:1], "part": rows["part"][:1], "content": built})

    found = rows.groupBy("packet", "part").applyInArrow(build, "packet string, part int, content binary")
    return found.withColumn("content_sha256", F.sha2("content", 256))


def publication(candidates: DataFrame, published: DataFrame) -> DataFrame:
    """Candidates (name, sha256) with action: PUBLISH, ALREADY_PUBLISHED for the same content, REFUSE for other content."""
    held = published.select("name", F.col("sha256").alias("held"))
    action = F.when(F.col("held").isNull(), "PUBLISH").when(F.col("held") == F.col("sha256"), "ALREADY_PUBLISHED").otherwise("REFUSE")
    return candidates.join(held, "name", "left").withColumn("action", action).drop("held")


def orphan_name(step: Column, name: Column, sha: Column) -> Column:
    return F.concat(F.lit("orphans/"), step, F.lit("/"), name, F.lit("."), F.left(sha, F.lit(16)), F.lit(".orphan"))


def expanded_cards(results: DataFrame) -> DataFrame:
    """Results (shared_extra, cards array<struct<scope, front, back, extra>>): problem cards get the shared extra."""
    shared = F.transform("cards", lambda c: F.when(c["scope"] == "problem", c.withField("extra", F.col("shared_extra"))).otherwise(c))
    return results.withColumn("cards", shared).drop("shared_extra")


def card_issues(results: DataFrame) -> DataFrame:
    """(result, location, issue) of cards: blank sides, unknown scope, repeated fronts."""
    rows = results.select("result", F.posexplode("cards").alias("i", "c"))
    front = text.strip(F.coalesce("c.front", F.lit("")))
    nth = F.count("*").over(Window.partitionBy("result", front))
    found = F.array_compact(
        F.array(
            F.when(front == "", "BLANK_FRONT"),
            F.when(text.strip(F.coalesce("c.back", F.lit(""))) == "", "BLANK_BACK"),
            F.when(~F.coalesce(F.col("c.scope"), F.lit("")).isin("problem", "general"), "UNKNOWN_SCOPE"),
            F.when((front != "") & (nth > 1), "DUPLICATE_FRONT"),
        )
    )
    rows = rows.withColumn("found", found)
    return rows.select("result", F.format_string("cards[%d]", "i").alias("location"), F.explode("found").alias("issue"))


def read_back(written: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """(key, field) for every column of `written` that reads back as something else; a lost row gives `missing`."""
    names = [c for c in written.columns if c != key]
    other = fetched.select(key, F.lit(True).alias("found"), *[F.col(c).alias(f"got_{c}") for c in names])
    rows = written.join(other, key, "left")
    wrong = F.array_compact(
        F.array(F.when(F.col("found").isNull(), "missing"), *[F.when(F.col("found") & ~F.col(c).eqNullSafe(F.col(f"got_{c}")), c) for c in names])
    )
    return rows.select(key, F.explode(wrong).alias("field"))


def cost(components: DataFrame) -> DataFrame:
    """(name, n_chars, n_bytes) of text components and their sum under `total`."""
    rows = components.select("name", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))
    total = rows.agg(F.lit("total").alias("name"), F.sum("n_chars").alias("n_chars"), F.sum("n_bytes").alias("n_bytes"))
    return rows.unionByName(total)
