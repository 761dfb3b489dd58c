"""Marker strokes and fills: classes, the text under them, logical markers, and their canonical ranges.

Sides made by an explode are joined by a sort: Spark takes an explode for as large as its input, and
would send millions of rows to the driver as a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import geometry as geo
from evidentia.functions import text
from evidentia.operators.graphs import roots

ON = ("document", "page_number")
MIN_STROKE = 3.0
MIN_WORD_OVERLAP = 0.15
RED_GAP = 12.0


def coloured(drawings: DataFrame) -> DataFrame:
    """Marks of drawings (see `classified`) with their paint, colour and kind, without the words under them."""
    named = lambda rgb: F.when(F.size(rgb) == 3, geo.nearest_colour(*[F.get(rgb, F.lit(n)) for n in range(3)]))
    # Named before the explode: filters above a projection would each name the colour again.
    paints = F.array(*[F.struct(F.lit(p).alias("paint"), named(F.col(p)).alias("color")) for p in ("stroke", "fill")])
    rows = drawings.select(*ON, "drawing_index", "rect", "width", F.explode(paints).alias("p")).select(*ON, "drawing_index", "rect", "width", "p.paint", "p.color").where("color is not null")
    marker = (F.col("color") != "red") & ((F.col("paint") == "fill") | (F.col("width") >= MIN_STROKE))
    return rows.withColumn("kind", F.when(F.col("color") == "red", "red_vector_evidence").when(marker, "marker_candidate")).where("kind is not null")


def classified(drawings: DataFrame, words: DataFrame) -> DataFrame:
    """Marks of drawings (document, page_number, drawing_index, rect, width, stroke, fill): stroke and fill apart.

    stroke and fill are arrays of three. Red is evidence without a meaning; other known colours
    are marker candidates if filled, or stroked with a width of 3 or more. `words` (document,
    page_number, block, line, word, text, bbox) give the text under a candidate.
    """
    rows = coloured(drawings)
    under = mark_words(rows.where("kind = 'marker_candidate'"), words)
    rows = rows.join(under.hint("merge"), [*ON, "drawing_index", "paint"], "left")
    clean = text.suspicious_count(F.col("word_candidate")) == 0
    sure = (
        F.when(F.col("kind") == "red_vector_evidence", 0.99)
        .when(F.col("word_candidate").isNull(), 0.70)
        .when(clean, 0.95)
        .otherwise(0.75)
    )
    return rows.withColumn("confidence", sure)


def mark_words(marks: DataFrame, words: DataFrame) -> DataFrame:
    """(…, drawing_index, paint, word_candidate): words under each mark in reading order."""
    pad = F.coalesce("width", F.lit(0.0)) / 2 + 1.0
    hits = marks.select(*ON, "drawing_index", "paint", "rect", pad.alias("pad")).join(words.hint("merge"), list(ON))
    shared = F.least(geo.edge(F.col("bbox"), 2), geo.edge(F.col("rect"), 2)) - F.greatest(geo.edge(F.col("bbox"), 0), geo.edge(F.col("rect"), 0))
    middle = (geo.edge(F.col("bbox"), 1) + geo.edge(F.col("bbox"), 3)) / 2
    inside = middle.between(geo.edge(F.col("rect"), 1) - F.col("pad"), geo.edge(F.col("rect"), 3) + F.col("pad"))
    hits = hits.where((shared / F.greatest(geo.width(F.col("bbox")), F.lit(0.1)) >= MIN_WORD_OVERLAP) & inside)
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "word", "text")))
    found = hits.groupBy(*ON, "drawing_index", "paint").agg(ordered.alias("w"))
    return found.select(*ON, "drawing_index", "paint", F.trim(F.array_join(F.transform("w", lambda w: w["text"]), " ")).alias("word_candidate"))


def fragments(marks: DataFrame, chars: DataFrame) -> DataFrame:
    """Marker candidates with the characters they hit, numbered on their page, and how sure their bounds are."""
    marks = marks.where("kind = 'marker_candidate'")
    order = W.partitionBy(*ON).orderBy("drawing_index", F.desc("paint"))
    marks = marks.withColumn("id", F.format_string("p%04d-mark-%03d", "page_number", F.row_number().over(order)))
    hits = marks.select(*ON, "id", "rect", "paint", "width").join(chars.select(*ON, "index", "c", "bbox", "block", "line").hint("merge"), list(ON))
    hits = hits.where(geo.marker_hits(F.col("bbox"), F.col("rect"), F.col("paint"), F.col("width")))
    held = hits.groupBy("document", "id").agg(F.array_sort(F.collect_list(F.struct("index", "c", "block", "line"))).alias("native_chars"))
    rows = marks.join(held.hint("merge"), ["document", "id"], "left")
    joined = F.array_join(F.transform("native_chars", lambda c: c["c"]), "")
    rows = rows.withColumn("exact_text", F.when(F.size("native_chars") > 0, joined))
    a, b = text.compact(text.comparable(F.col("exact_text"))), text.compact(text.comparable(F.col("word_candidate")))
    rows = rows.withColumn("agrees", (a != "") & (a == b))
    return rows.withColumns(
        {
            "start_char": F.array_min(F.transform("native_chars", lambda c: c["index"])),
            "end_char": F.array_max(F.transform("native_chars", lambda c: c["index"])),
            "boundary_confidence": F.when(F.col("agrees"), 0.98).when(F.size("native_chars") > 0, 0.65).otherwise(0.0),
            "review_status": F.when(F.col("agrees"), "AUTO_VERIFIED").otherwise("NEEDS_REVIEW"),
        }
    ).drop("agrees")


def adjacent(parts: DataFrame) -> DataFrame:
    """Pairs (document, a, b) of fragments of one page and colour that continue one another.

    They share a text line, their painted bands overlap, and they share a character or the one
    to the left ends right before the other begins.
    """
    band = geo.paint_band(F.col("rect"), F.col("paint"), F.col("width"))
    rows = parts.where("size(native_chars) > 0").select(
        *ON, "color", "id", "rect", band.alias("band"), "start_char", "end_char",
        F.transform("native_chars", lambda c: c["index"]).alias("indexes"),
        F.array_distinct(F.transform("native_chars", lambda c: F.struct(c["block"], c["line"]))).alias("lines"),
    )
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{n}") == F.col(f"b.{n}") for n in (*ON, "color")]
    left = geo.edge(F.col("a.rect"), 2) <= geo.edge(F.col("b.rect"), 0)
    right = geo.edge(F.col("b.rect"), 2) <= geo.edge(F.col("a.rect"), 0)
    follows = F.when(left, F.col("a.end_char") + 1 == F.col("b.start_char")).when(right, F.col("b.end_char") + 1 == F.col("a.start_char")).otherwise(False)
    band_meets = F.least("a.band.hi", "b.band.hi") >= F.greatest("a.band.lo", "b.band.lo")
    rows = a.join(b.hint("merge"), [*same, F.col("a.id") < F.col("b.id")])
    rows = rows.where(F.arrays_overlap("a.lines", "b.lines") & band_meets & (F.arrays_overlap("a.indexes", "b.indexes") | follows))
    return rows.select(F.col("a.document").alias("document"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(document, id, component): component is the smallest id reached over pairs (document, a, b), by star contraction."""
    node = lambda c: F.struct("document", F.col(c).alias("id"))
    found = roots(pairs.select(node("a").alias("u"), node("b").alias("v")))
    found = found.select("node.document", "node.id", F.col("root.id").alias("root"))
    rows = nodes.select("document", "id").join(found.hint("merge"), ["document", "id"], "left")
    return rows.select("document", "id", F.coalesce("root", "id").alias("component"))


def logical(parts: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row for each component of fragments: union box, widest stroke, least confidence, joined characters."""
    rows = parts.join(grouped.hint("merge"), ["document", "id"])
    firsts = F.array_sort(F.collect_list(F.struct("id", "word_candidate")))
    merged = rows.groupBy(*ON, "color", "component").agg(
        F.array(F.min(geo.edge(F.col("rect"), 0)), F.min(geo.edge(F.col("rect"), 1)), F.max(geo.edge(F.col("rect"), 2)), F.max(geo.edge(F.col("rect"), 3))).alias("bbox"),
        F.max(F.coalesce("width", F.lit(0.0))).alias("stroke_width"),
        F.min("boundary_confidence").alias("boundary_confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("native_chars")))).alias("native_chars"),
        F.array_sort(F.collect_set("drawing_index")).alias("raw_vector_ids"),
        F.bool_and(F.col("review_status") == "AUTO_VERIFIED").alias("verified"),
        F.min_by("paint", "id").alias("paint"),
        firsts.alias("named"),
    )
    order = W.partitionBy(*ON).orderBy("component")
    words = F.array_distinct(F.array_compact(F.transform("named", lambda x: x["word_candidate"])))
    joined = F.array_join(F.transform("native_chars", lambda c: c["c"]), "")
    return merged.select(
        *ON, F.format_string("p%04d-logical-mark-%03d", "page_number", F.row_number().over(order)).alias("id"), "color", "paint", "bbox", "stroke_width", "boundary_confidence", "raw_vector_ids",
        F.when(F.size("native_chars") > 0, joined).alias("exact_text"), words.alias("word_candidates"),
        F.when(F.col("verified"), "AUTO_VERIFIED").otherwise("NEEDS_REVIEW").alias("review_status"),
    )


def canonical_text(pages: DataFrame) -> DataFrame:
    """Pages with canonical_text and its source: a page of low trust uses its own recognised text, others the reconciled."""
    low = F.col("trust") == "low"
    seen = F.coalesce("page_ocr", F.lit("")) != ""
    return pages.withColumns(
        {
            "canonical_text": F.when(~low, F.col("reconciled_text")).when(seen, F.col("page_ocr")),
            "canonical_source": F.when(~low, "reconciled_text").when(seen, "full_page_ocr").otherwise("unavailable_requires_visual_review"),
        }
    ).withColumn("canonical_sha256", F.sha2("canonical_text", 256))


def anchored(marks: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Logical markers with their canonical range: the only place of their text, else a single line they cover wholly.

    `lines` (document, page_number, start, stop, bbox) are recognised lines placed in the canonical
    text. Markers of unknown pages pass through without a range.
    """
    rows = marks.join(pages.select(*ON, "canonical_text", "canonical_source", "width", "height", "rotation"), list(ON), "left")
    usable = (F.coalesce("exact_text", F.lit("")) != "") & ~text.has_bad_control(F.coalesce("exact_text", F.lit("")))
    rows = rows.withColumn("own", F.when(usable, text.unique_range(F.col("canonical_text"), F.col("exact_text"))))
    painted = geo.rotated(geo.paint_box(F.col("bbox"), F.col("paint"), F.col("stroke_width")), F.col("width"), F.col("height"), F.coalesce("rotation", F.lit(0)))
    rows = rows.withColumn("painted", painted)
    hits = rows.where("own is null").select("document", "id", "page_number", "painted").join(lines.withColumnRenamed("bbox", "line_box"), list(ON))
    hits = hits.where(geo.intersects(F.col("painted"), F.col("line_box"))).groupBy("document", "id").agg(
        F.count("*").alias("n"), F.bool_and(geo.covers(F.col("painted"), F.col("line_box"))).alias("whole"), F.struct(F.min("start").alias("start"), F.min("stop").alias("stop")).alias("line_range")
    )
    rows = rows.join(hits, ["document", "id"], "left")
    chosen = F.coalesce("own", F.when((F.col("n") == 1) & F.col("whole"), F.col("line_range")))
    rows = rows.withColumn("chosen", chosen)
    piece = F.substr("canonical_text", F.col("chosen.start") + 1, F.col("chosen.stop") - F.col("chosen.start"))
    sound = (F.col("review_status") == "AUTO_VERIFIED") & F.col("chosen").isNotNull() & text.is_accurate(piece)
    return rows.select(
        *marks.columns[:-1], F.col("chosen.start").alias("canonical_start"), F.col("chosen.stop").alias("canonical_stop"), F.col("canonical_source"), F.when(sound, "AUTO_VERIFIED").otherwise("NEEDS_REVIEW").alias("review_status")
    )


def red_clusters(marks: DataFrame, gap: float = RED_GAP) -> DataFrame:
    """(document, page_number, cluster, bbox): red rectangles within `gap` of each other as one, to a fixpoint.

    Pages pass in order, each as one list; clusters are numbered by their top left corner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*[c.to_pylist() for c in batch.columns], strict=True) for batch in batches)
        out: list[tuple] = []
        for page, marks in groupby(rows, key=lambda r: r[:2]):
            out += [(*page, n, box) for n, box in enumerate(_merged([list(m[3]) for m in marks], gap), 1)]
            if len(out) >= 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["document", "page_number", "cluster", "bbox"])

    red = marks.where("kind = 'red_vector_evidence'").select("document", F.col("page_number").cast("int").alias("page_number"), "drawing_index", "rect")
    ordered = red.repartition(*ON).sortWithinPartitions(*ON, "drawing_index", "rect")
    return ordered.mapInArrow(run, "document string, page_number int, cluster int, bbox array<double>")


def _merged(boxes: list[list[float]], gap: float) -> list[list[float]]:
    done: list[list[float]] = []
    while boxes:
        box = boxes.pop()
        near = next((o for o in boxes if _near(box, o, gap)), None)
        if near is None:
            done.append(box)
            continue
        boxes.remove(near)
        boxes.append([min(box[0], near[0]), min(box[1], near[1]), max(box[2], near[2]), max(box[3], near[3])])
        boxes += done  # a grown box may reach finished ones
        done = []
    return sorted(done, key=lambda b: (b[1], b[0]))


def _near(a: list[float], b: list[float], gap: float) -> bool:
    return a[0] - gap < b[2] and b[0] < a[2] + gap and a[1] - gap < b[3] and b[1] < a[3] + gap
