"""Geometry, colours and routing: expressions over numbers of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import geometry as geo
from evidentia.functions import text
from evidentia.operators import markers, routing
from evidentia.plans.registry import query
from evidentia.session import load
from evidentia.staging import stage

_BOXES = """
    with b as (select l_orderkey, l_linenumber, l_quantity as ax0, round(l_tax * 100) as ay0, l_quantity + 10 as ax1, round(l_tax * 100) + 5 as ay1,
      l_linenumber * 5.0::double as bx0, round(l_discount * 100) as by0, l_linenumber * 5.0::double + 12 as bx1, round(l_discount * 100) + 6 as by1,
      (l_linenumber % 4) * 90 as turn from lineitem),
    i as (select *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0.0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0.0) as area from b)
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.round(F.col("l_tax") * 100)
    u, v = F.col("l_linenumber") * 5.0, F.round(F.col("l_discount") * 100)
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", geo.box(x, y, x + 10, y + 5).alias("a"), geo.box(u, v, u + 12, v + 6).alias("b"), ((F.col("l_linenumber") % 4) * 90).alias("turn")
    )


@query(
    _BOXES
    + """select l_orderkey, l_linenumber, round(area / greatest((ax1 - ax0) * (ay1 - ay0), 1e-9), 6) as overlap,
         ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1 as meets,
         ax0 <= bx0 + 1 and ay0 <= by0 + 1 and ax1 >= bx1 - 1 and ay1 >= by1 - 1 as covers,
         round((ax1 - ax0) * (ay1 - ay0) / 10000.0, 6) as coverage from i"""
)
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _boxes(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        F.round(geo.overlap_ratio(a, b), 6).alias("overlap"),
        geo.intersects(a, b).alias("meets"),
        geo.covers(a, b).alias("covers"),
        F.round(geo.page_coverage(a, F.lit(100.0), F.lit(100.0)), 6).alias("coverage"),
    )


@query(
    _BOXES
    + """select l_orderkey, l_linenumber,
         case turn when 0 then ax0 when 90 then 100 - ay1 when 180 then 100 - ax1 else ay0 end as rx0,
         case turn when 0 then ay0 when 90 then ax0 when 180 then 200 - ay1 else 200 - ax1 end as ry0,
         case turn when 0 then ax1 when 90 then 100 - ay0 when 180 then 100 - ax0 else ay1 end as rx1,
         case turn when 0 then ay1 when 90 then ax1 when 180 then 200 - ay0 else 200 - ax0 end as ry1 from i"""
)
def rotation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = geo.rotated(F.col("a"), F.lit(100.0), F.lit(200.0), F.col("turn"))
    found = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", r.alias("r"))
    return found.select("l_orderkey", "l_linenumber", *[geo.edge(F.col("r"), n).alias(c) for n, c in enumerate(("rx0", "ry0", "rx1", "ry1"))])


@query(
    _BOXES
    + """select l_orderkey, l_linenumber, -0.5 * ay1 + 100 as mx0, 0.5 * ax0 + 20 as my0, -0.5 * ay0 + 100 as mx1, 0.5 * ax1 + 20 as my1 from i"""
)
def affine_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter-turned pixel map of each box."""
    m = geo.affine(F.col("a"), F.array(*[F.lit(v) for v in (0.0, 0.5, -0.5, 0.0, 100.0, 20.0)]))
    found = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", m.alias("m"))
    return found.select("l_orderkey", "l_linenumber", *[geo.edge(F.col("m"), n).alias(c) for n, c in enumerate(("mx0", "my0", "mx1", "my1"))])


_DISTANCE = " union all ".join(
    f"select *, {n} as nth, '{name}' as colour, sqrt(pow(r - {c[0]}, 2) + pow(g - {c[1]}, 2) + pow(b - {c[2]}, 2)) as d from c"
    for n, (name, c) in enumerate(geo.COLOURS.items())
)


@query(
    f"""with c as (select row_number() over () as row, l_orderkey, l_linenumber, l_quantity / 50 as r, l_discount * 10 as g, l_tax * 12 as b from lineitem),
        ranked as (select *, row_number() over (partition by row order by d, nth) as k from ({_DISTANCE}))
        select l_orderkey, l_linenumber, case when d <= {geo.COLOUR_TOLERANCE} then colour end as colour from ranked where k = 1"""
)
def nearest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geo.nearest_colour(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("colour"))


@query(
    """select a.vec_id, round(1.0 - list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: abs(a.embedding[i] - b.embedding[i])::double)) / len(a.embedding) / 255.0, 6) as similarity
       from embeddings a join embeddings b on b.vec_id = a.vec_id + 1"""
)
def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each image signature to the next."""
    a = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(geo.signature_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    """with c as (select c_custkey, c_custkey % 9 as a, c_custkey % 13 + 1 as b, c_custkey % 7 as c from customer)
       select c_custkey, concat(a, ' - ', b, ',', c) as literal, case when a >= 1 and a <= b and c >= 1 then array_to_string(list_sort(list_distinct(list_append(range(a, b + 1), c))), ',') end as page_numbers from c"""
)
def page_list_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    literal = F.concat((n % 9).cast("string"), F.lit(" - "), (n % 13 + 1).cast("string"), F.lit(","), (n % 7).cast("string"))
    found = F.array_join(F.transform(text.page_list(F.col("literal")), lambda p: p.cast("string")), ",")
    return load(spark, sf_dir, "customer").select("c_custkey", literal.alias("literal")).select("c_custkey", "literal", found.alias("page_numbers"))


# Each customer's document has a page whose shapes depend on its number.


def _documents(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("document"), F.lit(1).alias("page_number"), *columns)


def _fixed_box(*edges: float):
    return F.array(*[F.lit(e) for e in edges])


@query(
    """with c as (select c_custkey as k, c_custkey % 4 = 0 as whole, c_custkey % 2 = 0 as full_page from customer)
       select k, 'full_page' as kind, null::bigint as source_index, null as suppress_reason from c where full_page
       union all select k, 'suspect_native_text', 0, case when full_page then 'redundant_with_full_page_ocr_scan_like_text_layer' end from c
       union all select k, 'image_region', 0, case when full_page and whole then 'duplicate_of_full_page_ocr_background_image' end from c"""
)
def target_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substantive image, the whole page on each fourth, beside a tiny one; each second page is read in full."""
    k, names = F.col("c_custkey"), ("document", "page_number")
    size = (F.lit(600.0).alias("page_width"), F.lit(850.0).alias("page_height"))
    docs = _documents(spark, sf_dir)
    large = F.struct(F.lit(0).alias("image_index"), F.when(k % 4 == 0, _fixed_box(0.0, 0.0, 600.0, 850.0)).otherwise(_fixed_box(100.0, 100.0, 400.0, 300.0)).alias("bbox"), F.lit(900).alias("width_px"), F.lit(600).alias("height_px"))
    tiny = F.struct(F.lit(1).alias("image_index"), _fixed_box(300.0, 500.0, 340.0, 510.0).alias("bbox"), F.lit(300).alias("width_px"), F.lit(200).alias("height_px"))
    regions = docs.select(*names, F.explode(F.array(large, tiny)).alias("r")).select(*names, "r.*", *size)
    page_rows = docs.select(*names, (k % 2 == 0).alias("full_page"), (k % 2 == 0).alias("scan_like"), *size)
    suspects = docs.select(*names, F.lit(0).alias("source_index"), _fixed_box(10.0, 10.0, 90.0, 30.0).alias("bbox"), F.lit("x").alias("native_candidate"))
    marks = docs.limit(0).select(*names, _fixed_box(0.0).alias("mark_box"))
    found = routing.plan(page_rows, suspects, regions, marks)
    return found.select(F.col("document").cast("long").alias("k"), "kind", F.col("source_index").cast("long").alias("source_index"), "suppress_reason")


@query(
    """with h as (select c_custkey as k, unnest(range(0, c_custkey % 6)) as image_index from customer),
       m as (select * from h where not (k % 7 = 0 and image_index = 0)), c as (select k, count(*) as n from m group by 1)
       select m.k, image_index from m join c on c.k = m.k where n >= 3 and m.k % 3 <> 0"""
)
def edge_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes along an edge: noise where three or more are evenly spaced; on each third page the last one isn't, on each seventh a mark protects the first."""
    k, names = F.col("c_custkey"), ("document", "page_number")
    docs = _documents(spark, sf_dir, (k % 6).cast("int").alias("n")).where("n > 0")
    holes = docs.select("c_custkey", *names, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("image_index"))
    y = F.col("image_index") * 100.0 + F.when((k % 3 == 0) & (F.col("image_index") == F.col("n") - 1), 90.0).otherwise(0.0)
    regions = holes.select(*names, "image_index", geo.box(F.lit(5.0), y, F.lit(25.0), y + 20).alias("bbox"), F.lit(60).alias("width_px"), F.lit(60).alias("height_px"), F.lit(600.0).alias("page_width"), F.lit(850.0).alias("page_height"))
    marks = docs.where(k % 7 == 0).select(*names, _fixed_box(0.0, 0.0, 30.0, 10.0).alias("mark_box"))
    found = routing.edge_noise(regions, marks, routing.Routing())
    return found.select(F.col("document").cast("long").alias("k"), F.col("image_index").cast("long").alias("image_index"))


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drawings, words and characters: two strokes that continue one another, the second only on even pages, one on a line of its own, red boxes, a thin line."""
    k, names = F.col("c_custkey"), ("document", "page_number")
    docs = _documents(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *names)  # so that all joins on pages find their rows in place
    colour = lambda name: F.array(*[F.lit(v) for v in geo.COLOURS[name]])
    drawing = lambda i, rect, width, name: F.struct(F.lit(i).alias("drawing_index"), rect.alias("rect"), F.lit(width).alias("width"), colour(name).alias("stroke"), F.lit(None).cast("array<double>").alias("fill"))
    gap = (k % 20).cast("double")
    second = F.when(k % 2 == 0, F.array(drawing(1, _fixed_box(40.6, 104.0, 70.0, 104.0), 8.0, "yellow")))
    others = F.array(
        drawing(0, _fixed_box(10.0, 104.0, 39.4, 104.0), 8.0, "yellow"), drawing(2, _fixed_box(10.0, 204.0, 40.0, 204.0), 8.0, "yellow"),
        drawing(3, _fixed_box(300.0, 300.0, 320.0, 320.0), 1.0, "red"), drawing(4, geo.box(gap + 320, F.lit(305.0), gap + 340, F.lit(325.0)), 1.0, "red"),
        drawing(5, _fixed_box(500.0, 500.0, 510.0, 510.0), 1.0, "red"), drawing(6, _fixed_box(10.0, 300.0, 40.0, 300.0), 1.0, "blue"),
    )
    drawings = docs.select(*names, F.explode(F.concat(others, F.coalesce(second, F.slice(others, 1, 0)))).alias("d")).select(*names, "d.*")
    word = lambda line, n, t, x, y: F.struct(F.lit(0).alias("block"), F.lit(line).alias("line"), F.lit(n).alias("word"), F.lit(t).alias("text"), _fixed_box(x, y, x + 30, y + 8).alias("bbox"))
    words = F.array(word(0, 0, "abc", 10.0, 100.0), word(0, 1, "def", 40.0, 100.0), word(1, 0, "ghi", 10.0, 200.0))
    char = lambda i, c: F.struct(
        F.lit(i).alias("index"), F.lit(c).alias("c"), _fixed_box(10.0 + 10 * (i % 6), 100.0 + 100 * (i // 6), 20.0 + 10 * (i % 6), 108.0 + 100 * (i // 6)).alias("bbox"), F.lit(0).alias("block"), F.lit(i // 6).alias("line")
    )
    chars = F.array(*[char(i, c) for i, c in enumerate("abcdefghi")])
    listed = lambda rows: docs.select(*names, F.explode(rows).alias("r")).select(*names, "r.*")
    return drawings, listed(words), listed(chars)


@query(
    """select c_custkey as k, 'p0001-logical-mark-001' as id, case when c_custkey % 2 = 0 then 'abcdef' else 'abc' end as exact_text, 'AUTO_VERIFIED' as review_status, 0.98::double as boundary_confidence, 10.0::double as x0,
         case when c_custkey % 2 = 0 then 70.0 else 39.4 end::double as x1 from customer
       union all select c_custkey, 'p0001-logical-mark-002', 'ghi', 'AUTO_VERIFIED', 0.98, 10.0, 40.0 from customer"""
)
def logical_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that continue one another, as one marker."""
    drawings, words, chars = _marks(spark, sf_dir)
    parts = stage(markers.fragments(markers.classified(drawings, words), chars), "fragments")
    merged = markers.logical(parts, markers.components(parts, markers.adjacent(parts)))
    return merged.select(F.col("document").cast("long").alias("k"), "id", "exact_text", "review_status", "boundary_confidence", geo.edge(F.col("bbox"), 0).alias("x0"), geo.edge(F.col("bbox"), 2).alias("x1"))


@query(
    """with c as (select c_custkey as k, (c_custkey % 20)::double as g from customer)
       select k, 1 as cluster, 300.0::double as x0, 300.0::double as y0, case when g < 12 then g + 340 else 320.0 end as x1, case when g < 12 then 325.0 else 320.0 end::double as y1 from c
       union all select k, 2, g + 320, 305, g + 340, 325 from c where g >= 12 union all select k, case when g < 12 then 2 else 3 end, 500, 500, 510, 510 from c"""
)
def red_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red boxes at gaps of 0 to 19, which are one up to a gap of 12."""
    found = markers.red_clusters(markers.coloured(_marks(spark, sf_dir)[0]))
    return found.select(F.col("document").cast("long").alias("k"), F.col("cluster").cast("long").alias("cluster"), *[geo.edge(F.col("bbox"), n).alias(c) for n, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("select doc_id::varchar as id, min(doc_id) over (partition by text)::varchar as component from documents")
def marker_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over links of each document to the next of equal text; ids compare by number here."""
    from pyspark.sql import Window as W

    docs = load(spark, sf_dir, "documents").select(F.lit("d").alias("document"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.sha2("text", 256).alias("h"))
    links = docs.select("document", F.lag("id").over(W.partitionBy("h").orderBy("id")).alias("a"), F.col("id").alias("b")).where("a is not null")
    found = markers.components(docs, links)
    return found.select(*[F.col(c).cast("long").cast("string").alias(c) for c in ("id", "component")])
