"""Completion stamps by image signature: embedded images first, rendered regions as a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import geometry as geo

# Limits of a match.
ASPECT_TOLERANCE = 0.30
EMBEDDED_SCORE = 0.88
RENDERED_SCORE = 0.84
MIN_X = 0.50
MIN_Y = 0.55


def detect(images: DataFrame, template: DataFrame) -> DataFrame:
    """(document, page_number, method, score) of pages with a stamp, the better of both methods.

    `images` (document, page_number, method, bbox, signature array<double>, page_width, page_height)
    are embedded or rendered regions, `template` one row (signature, aspect). An embedded one must lie
    in the lower right and have about the stamp's shape.
    """
    stamp = template.limit(1).select(F.col("signature").alias("stamp"), "aspect")
    rows = images.join(F.broadcast(stamp), how="cross")  # one row
    box = F.col("bbox")
    aspect = geo.width(box) / F.greatest(geo.height(box), F.lit(1e-9))
    shaped = geo.relative_difference(aspect, F.col("aspect")) <= ASPECT_TOLERANCE
    placed = (geo.edge(box, 0) >= F.col("page_width") * MIN_X) & (geo.edge(box, 1) >= F.col("page_height") * MIN_Y)
    alike = F.when(F.size("signature") == F.size("stamp"), geo.signature_similarity(F.col("signature"), F.col("stamp")))
    rows = rows.withColumn("score", alike)
    embedded = (F.col("method") == "embedded") & shaped & placed & (F.col("score") >= EMBEDDED_SCORE)
    rendered = (F.col("method") == "rendered") & (F.col("score") >= RENDERED_SCORE)
    best = F.max(F.struct("score", (F.col("method") == "embedded").alias("first"), "method"))
    return rows.where(embedded | rendered).groupBy("document", "page_number").agg(best.alias("b")).select("document", "page_number", "b.method", "b.score")
