"""Alignment of two versions of a document's pages.

Pages of equal id pair by occurrence; what is left pairs by text similarity, best first;
what is still left is deleted or new.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.text import character_counts, ratio_from
from evidentia.staging import stage

# Fixed values of the approximate stage.
MIN_LENGTH = 40
SIZE_DELTA = 1.0
MIN_SIMILARITY = 0.985

RECORD = (
    "document string, stable_page_id string, previous_page int, current_page int, classification string, "
    "markup_changed boolean, similarity double, reusable boolean"
)


def _occurrence(pages: DataFrame, side: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("document", "stable_page_id").orderBy("page_number"))
    names = ("page_number", "vector_fingerprint", "annotation_fingerprint")
    return pages.select("document", "stable_page_id", nth.alias("nth"), *[F.col(n).alias(f"{side}_{n}") for n in names])


def exact(old: DataFrame, new: DataFrame) -> DataFrame:
    """All pages of both versions, the k-th of an id beside the k-th; unpaired ones are DELETED or NEW for now."""
    rows = _occurrence(old, "old").join(_occurrence(new, "new"), ["document", "stable_page_id", "nth"], "full")
    moved = F.col("old_page_number") != F.col("new_page_number")
    differs = lambda n: F.col(f"old_{n}") != F.col(f"new_{n}")
    markup = differs("vector_fingerprint") | differs("annotation_fingerprint")
    kind = (
        F.when(F.col("old_page_number").isNull(), "NEW")
        .when(F.col("new_page_number").isNull(), "DELETED")
        .when(moved & markup, "MOVED_MARKUP_CHANGED")
        .when(moved, "MOVED")
        .when(markup, "MARKUP_CHANGED")
        .otherwise("SAME")
    )
    paired = F.col("old_page_number").isNotNull() & F.col("new_page_number").isNotNull()
    return rows.select(
        "document",
        "stable_page_id",
        F.col("old_page_number").alias("previous_page"),
        F.col("new_page_number").alias("current_page"),
        kind.alias("classification"),
        F.coalesce(markup, F.lit(False)).alias("markup_changed"),
        F.when(paired, 1.0).alias("similarity"),
        paired.alias("reusable"),
    )


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Similar pages (document, previous_page, current_page, similarity, markup_changed) of two leftovers.

    Only pages of equal images, nearly equal size and of lengths that allow the least similarity meet:
    lengths are dealt into bands so wide that no such pair lies more than one band apart. Characters in
    common, counted by classes of code points, bound the ratio from above and lose no pair. Pages meet
    without their texts; the ratio itself is order-dependent and computed in Python for what is left.
    """
    shortest = MIN_SIMILARITY / (2 - MIN_SIMILARITY)  # of the longer length
    band = F.floor(F.log(F.length("normalized_text").cast("double")) / -math.log(shortest)).alias("band")

    def pick(df: DataFrame, side: str) -> DataFrame:
        named = [F.col(c).alias(f"{side}_{c}") for c in ("page_number", "width", "height", "normalized_text", "vector_fingerprint", "annotation_fingerprint")]
        length, counts = F.length("normalized_text").alias(f"{side}_length"), character_counts(F.col("normalized_text")).alias(f"{side}_counts")
        rows = df.where(F.length("normalized_text") >= MIN_LENGTH).select("document", "image_fingerprint", band, *named, length, counts)
        return stage(rows, f"{side}_pages")

    olds, news = pick(old, "old"), pick(new, "new")
    a, b = F.col("old_length"), F.col("new_length")
    common = F.aggregate(F.zip_with("old_counts", "new_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    near = (
        (F.abs(F.col("old_width") - F.col("new_width")) <= SIZE_DELTA)
        & (F.abs(F.col("old_height") - F.col("new_height")) <= SIZE_DELTA)
        & (F.least(a, b) * 2 >= (a + b) * MIN_SIMILARITY)
    )
    markup = (F.col("old_vector_fingerprint") != F.col("new_vector_fingerprint")) | (
        F.col("old_annotation_fingerprint") != F.col("new_annotation_fingerprint")
    )
    beside = olds.drop("old_normalized_text").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    rows = beside.join(news.drop("new_normalized_text"), ["document", "image_fingerprint", "band"]).where(near)
    rows = rows.where(common * 2 >= (a + b) * MIN_SIMILARITY).select("document", "old_page_number", "new_page_number", markup.alias("markup_changed"))
    for side, pages in (("old", olds), ("new", news)):
        rows = rows.join(pages.select("document", f"{side}_page_number", f"{side}_normalized_text"), ["document", f"{side}_page_number"])
    rows = rows.withColumn("similarity", ratio_from(MIN_SIMILARITY)(F.col("old_normalized_text"), F.col("new_normalized_text")))
    return rows.where("similarity is not null").select(
        "document", F.col("old_page_number").alias("previous_page"), F.col("new_page_number").alias("current_page"), "similarity", "markup_changed"
    )


def greedy(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of each document, by falling similarity, ties by previous and current page."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["similarity", "previous_page", "current_page"], ascending=[False, True, True])
        old, new, keep = set(), set(), []
        for p, c in zip(rows["previous_page"], rows["current_page"], strict=True):
            keep.append(p not in old and c not in new)
            if keep[-1]:
                old.add(p)
                new.add(c)
        return rows[keep]

    return pairs.groupBy("document").applyInPandas(match, pairs.schema)


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full alignment of two versions of identified pages (see pages.identity).

    What several later steps read, the exact alignment and the pairs by similarity, is staged, so as not to be made anew.
    """
    first = stage(exact(old, new), "exact")

    def side(df: DataFrame, column: str) -> DataFrame:
        """Pages that the exact alignment leaves over; staged, else Spark would measure the texts of all pages before it drops them."""
        left = first.where(F.col("classification") == ("DELETED" if column == "previous_page" else "NEW")).select("document", F.col(column).alias("page_number"))
        names = ("document", "page_number", "image_fingerprint", "width", "height", "normalized_text", "vector_fingerprint", "annotation_fingerprint")
        return stage(df.join(left, ["document", "page_number"], "left_semi").select(*names), "left")

    matched = stage(greedy(candidates(side(old, "previous_page"), side(new, "current_page"))), "matched")
    kind = F.when(F.col("previous_page") == F.col("current_page"), "CONTENT_CHANGED").otherwise("MOVED_CONTENT_CHANGED")
    changed = matched.select(
        "document", F.lit(None).cast("string").alias("stable_page_id"), "previous_page", "current_page", kind.alias("classification"), "markup_changed", F.round("similarity", 6).alias("similarity"), F.lit(False).alias("reusable")
    )
    used_old = changed.select("document", "previous_page", F.lit(True).alias("used_old"))
    used_new = changed.select("document", "current_page", F.lit(True).alias("used_new"))
    rest = first.join(used_old, ["document", "previous_page"], "left").join(used_new, ["document", "current_page"], "left")
    paired = F.col("classification").isin("DELETED", "NEW") & (F.col("used_old").isNotNull() | F.col("used_new").isNotNull())
    return rest.where(~paired).select(*changed.columns).unionByName(changed)


def changed_pages(alignment: DataFrame) -> DataFrame:
    """Current pages that are neither the same nor only moved."""
    rows = alignment.where(~F.col("classification").isin("SAME", "MOVED") & F.col("current_page").isNotNull())
    return rows.select("document", "current_page").distinct()


def requested(alignment: DataFrame, pages: DataFrame | None) -> DataFrame:
    """Records whose previous page is asked for (document, page_number); all without a request."""
    if pages is None:
        return alignment
    asked = pages.select("document", F.col("page_number").alias("previous_page"))
    return alignment.join(asked, ["document", "previous_page"], "left_semi")


def revisions(items: DataFrame, alignment: DataFrame) -> DataFrame:
    """Items (document, item, pages) that touch a changed previous page, with the current page of their last one."""
    touched = alignment.where(~F.col("classification").isin("SAME", "MOVED") & F.col("previous_page").isNotNull())
    rows = items.select("document", "item", "pages", F.explode("pages").alias("previous_page"))
    hit = rows.join(touched.select("document", "previous_page"), ["document", "previous_page"]).select("document", "item", F.array_max("pages").alias("previous_page")).distinct()
    return hit.join(alignment.select("document", "previous_page", "current_page"), ["document", "previous_page"], "left").select("document", "item", "current_page")
