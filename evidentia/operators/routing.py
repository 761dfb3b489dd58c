"""What to send to text recognition: full pages, suspect spans, substantive images; and what to hold back.

Regions are rows (document, page_number, image_index, bbox, width_px, height_px, page_width, page_height).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import geometry as geo
from evidentia.functions.hashing import payload_hash


@dataclass(frozen=True)
class Routing:
    """Limits of the planner."""

    dpi: int = 300
    surgical_dpi: int = 450
    min_width_px: int = 256
    min_height_px: int = 128
    min_width: float = 48.0
    min_height: float = 24.0
    min_coverage: float = 0.01
    surgical_padding: float = 6.0
    background_coverage: float = 0.80
    edge_band: float = 0.12
    edge_width: float = 0.12
    edge_height: float = 0.12
    aspect_min: float = 0.55
    aspect_max: float = 1.80
    size_tolerance: float = 0.35
    spacing_tolerance: float = 0.35
    repetitions: int = 3

    def __post_init__(self) -> None:
        if {self.dpi, self.surgical_dpi} - {300, 450, 600}:
            raise ValueError("dpi must be 300, 450 or 600")
        for f in fields(self):
            if f.name.startswith(("edge", "background", "min_coverage")) and not 0 <= getattr(self, f.name) <= 1:
                raise ValueError(f"{f.name} must be within 0 and 1")
        if self.aspect_min > self.aspect_max or self.repetitions < 3:
            raise ValueError("aspect_min must not pass aspect_max, and repetitions be 3 at least")


def substantive(r: Routing) -> Column:
    """Whether an image region is worth reading; null pixel sizes aren't."""
    box = F.col("bbox")
    return F.coalesce(
        (F.col("width_px") >= r.min_width_px)
        & (F.col("height_px") >= r.min_height_px)
        & (geo.width(box) >= r.min_width)
        & (geo.height(box) >= r.min_height)
        & (geo.page_coverage(box, F.col("page_width"), F.col("page_height")) >= r.min_coverage),
        F.lit(False),
    )


def edge_side(r: Routing) -> Column:
    """`left` or `right` for a small roundish region inside that page edge's band, else null."""
    box, page = F.col("bbox"), F.col("page_width")
    aspect, raw = geo.width(box) / geo.height(box), F.col("width_px") / F.col("height_px")
    small = (geo.width(box) <= page * r.edge_width) & (geo.height(box) <= F.col("page_height") * r.edge_height)
    pixels = F.when(F.col("width_px").isNull() | F.col("height_px").isNull(), True).otherwise(
        (F.col("width_px") > 0) & (F.col("height_px") > 0) & raw.between(r.aspect_min, r.aspect_max)
    )
    fits = (geo.width(box) > 0) & (geo.height(box) > 0) & small & aspect.between(r.aspect_min, r.aspect_max) & pixels
    side = F.when(geo.edge(box, 0) <= page * r.edge_band, "left").when(geo.edge(box, 2) >= page * (1 - r.edge_band), "right")
    return F.when(fits, side)


def protected(regions: DataFrame, marks: DataFrame) -> DataFrame:
    """Regions that share area with a mark or annotation (document, page_number, mark_box)."""
    on = ["document", "page_number"]
    rows = regions.select(*on, "image_index", "bbox").join(marks.select(*on, "mark_box"), on)
    return rows.where(geo.intersects(F.col("bbox"), F.col("mark_box"))).select(*on, "image_index").distinct()


def edge_noise(regions: DataFrame, marks: DataFrame, r: Routing) -> DataFrame:
    """(document, page_number, image_index) of repeated edge images such as binder holes.

    For each seed on a side the regions of its size; a cluster counts from `repetitions` members
    on whose centres are spaced evenly. Clusters are not closed transitively.
    """
    on = ["document", "page_number"]
    rows = regions.withColumn("side", edge_side(r)).where("side is not null")
    rows = rows.join(protected(regions, marks), [*on, "image_index"], "left_anti")
    rows = rows.select(*on, "side", "image_index", geo.width(F.col("bbox")).alias("w"), geo.height(F.col("bbox")).alias("h"), ((geo.edge(F.col("bbox"), 1) + geo.edge(F.col("bbox"), 3)) / 2).alias("centre"))
    seeds = rows.select(*on, "side", F.col("image_index").alias("seed"), F.col("w").alias("seed_w"), F.col("h").alias("seed_h"))
    alike = (geo.relative_difference(F.col("w"), F.col("seed_w")) <= r.size_tolerance) & (geo.relative_difference(F.col("h"), F.col("seed_h")) <= r.size_tolerance)
    members = rows.join(seeds, [*on, "side"]).where(alike)
    cluster = members.groupBy(*on, "side", "seed").agg(F.array_sort(F.collect_list("centre")).alias("centres"), F.collect_list("image_index").alias("members"))
    gaps = F.zip_with(F.slice("centres", 2, F.greatest(F.size("centres") - 1, F.lit(0))), F.slice("centres", 1, F.greatest(F.size("centres") - 1, F.lit(0))), lambda b, a: b - a)
    cluster = cluster.withColumn("gaps", F.array_sort(gaps)).where(F.size("members") >= r.repetitions)
    median = F.get("gaps", F.floor(F.size("gaps") / 2).cast("int"))
    even = (F.get("gaps", F.lit(0)) > 0) & F.forall("gaps", lambda g: F.abs(g - median) / median <= r.spacing_tolerance)
    return cluster.where(even).select(*on, F.explode("members").alias("image_index")).distinct()


def plan(pages: DataFrame, suspects: DataFrame, regions: DataFrame, marks: DataFrame, r: Routing = Routing()) -> DataFrame:
    """All targets with suppress_reason, null for those to execute.

    `pages` (document, page_number, full_page, scan_like, page_width, page_height), `suspects`
    (document, page_number, source_index, bbox, native_candidate), `regions` as above.
    """
    on = ["document", "page_number"]
    empty = lambda kind: F.lit(None).cast(kind)
    full = pages.where("full_page").select(
        *on, F.lit("full_page").alias("kind"), empty("int").alias("source_index"), geo.box(F.lit(0.0), F.lit(0.0), F.col("page_width"), F.col("page_height")).alias("bbox"), empty("string").alias("native_candidate"), F.lit(r.dpi).alias("dpi"), empty("string").alias("suppress_reason")
    )
    scan = F.when(F.col("scan_like") & F.col("full_page"), "redundant_with_full_page_ocr_scan_like_text_layer")
    surgical = suspects.join(pages, on).select(
        *on, F.lit("suspect_native_text").alias("kind"), "source_index", "bbox", "native_candidate", F.lit(r.surgical_dpi).alias("dpi"), scan.alias("suppress_reason")
    )
    noise = edge_noise(regions, marks, r).withColumn("noise", F.lit(True))
    images = regions.where(substantive(r)).join(noise, [*on, "image_index"], "left").join(pages.select(*on, "full_page", "scan_like"), on)
    share = geo.page_coverage(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    held = F.when(F.col("noise"), "repetitive_edge_image_noise_likely_binder_hole").when(F.col("full_page") & (share >= r.background_coverage), "duplicate_of_full_page_ocr_background_image")
    images = images.select(*on, F.lit("image_region").alias("kind"), F.col("image_index").alias("source_index"), "bbox", empty("string").alias("native_candidate"), F.lit(r.dpi).alias("dpi"), held.alias("suppress_reason"))
    return full.unionByName(surgical).unionByName(images)


def target_key(stable_page_id: Column, kind: Column, bbox: Column, dpi: Column, padding: Column, image_sha: Column, backend: Column) -> Column:
    """Cache key of a target: what its recognised text depends on."""
    return payload_hash(
        page=stable_page_id, kind=kind, bbox=F.transform(bbox, lambda v: F.round(v, 4)), dpi=dpi, padding=padding, image=image_sha, backend=backend
    )


def ordinals(targets: DataFrame, *ties: str) -> DataFrame:
    """Targets with target_id p0001-kind-001, counted from 1 by kind on each page; `ties` order those of one source_index."""
    order = W.partitionBy("document", "page_number", "kind").orderBy(F.asc_nulls_first("source_index"), *ties)
    return targets.withColumn("target_id", F.format_string("p%04d-%s-%03d", "page_number", "kind", F.row_number().over(order)))


def pixel_map(box: Column, px_width: Column, px_height: Column, rotation: Column) -> Column:
    """Affine map [a, b, c, d, e, f] from a crop's pixels to the page, for quarter turns."""
    x0, y0, x1, y1 = (geo.edge(box, n) for n in range(4))
    sx, sy = (x1 - x0) / px_width, (y1 - y0) / px_height
    tx, ty = (x1 - x0) / px_height, (y1 - y0) / px_width
    zero = F.lit(0.0)
    turn = F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 0, F.array(sx, zero, zero, sy, x0, y0))
        .when(turn == 90, F.array(zero, -ty, tx, zero, x0, y1))
        .when(turn == 180, F.array(-sx, zero, zero, -sy, x1, y1))
        .when(turn == 270, F.array(zero, ty, -tx, zero, x1, y0))
        .otherwise(F.raise_error(F.lit("rotation must be a multiple of 90")).cast("array<double>"))
    )
