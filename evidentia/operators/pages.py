"""Pages: explodes of extracted text, measures, trust, mode, and content identity.

A page row has document, page_number, width, height, rotation, native_text, and nested
extraction results where the source gives them: blocks > lines > spans > chars, images
(digest, bbox, width_px, height_px), drawings, annotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions import geometry as geo
from evidentia.functions import hashing, text

# Thresholds of trust and mode.
MIN_CHARS = 120
MIN_QUALITY = 0.82
SCAN_COVERAGE = 0.80
LARGE_IMAGE = 0.20
SCRIPT_GATE = 0.15


def from_documents(docs: DataFrame, document: Column | None = None) -> DataFrame:
    """Driver documents as pages of one corpus, or of the `document` given: no images, A4, unrotated."""
    return docs.select(
        (F.lit("corpus") if document is None else document).alias("document"),
        F.col("doc_id").cast("int").alias("page_number"),
        F.lit(595.0).alias("width"),
        F.lit(842.0).alias("height"),
        F.lit(0).alias("rotation"),
        F.col("text").alias("native_text"),
    )


def chosen(pages: DataFrame, numbers: Column | None) -> DataFrame:
    """Pages in the requested list; all where the list is null."""
    return pages if numbers is None else pages.where(numbers.isNull() | F.array_contains(numbers, F.col("page_number")))


def text_blocks(blocks: Column) -> Column:
    """Blocks of text (type 0), in extraction order."""
    return F.filter(blocks, lambda b: b["type"] == 0)


def spans(pages: DataFrame) -> DataFrame:
    """A row for each span with text: block, line, span places and its fields."""
    rows = pages.select("document", "page_number", F.posexplode(text_blocks(F.col("blocks"))).alias("block", "b"))
    rows = rows.select("document", "page_number", "block", F.posexplode("b.lines").alias("line", "l"))
    rows = rows.select("document", "page_number", "block", "line", F.posexplode("l.spans").alias("span", "s"))
    return rows.where("s.text <> ''").select("document", "page_number", "block", "line", "span", "s.*")


def chars(pages: DataFrame) -> DataFrame:
    """A row for each character with a whole box, numbered from 0 in extraction order on its page."""
    rows = pages.select("document", "page_number", F.posexplode(text_blocks(F.col("blocks"))).alias("block", "b"))
    rows = rows.select("document", "page_number", "block", F.posexplode("b.lines").alias("line", "l"))
    rows = rows.select("document", "page_number", "block", "line", F.posexplode("l.spans").alias("span", "s"))
    rows = rows.select("document", "page_number", "block", "line", "span", F.posexplode("s.chars").alias("nth", "c"))
    rows = rows.where("size(c.bbox) = 4").select("document", "page_number", "block", "line", "span", "nth", "c.c", "c.bbox")
    order = W.partitionBy("document", "page_number").orderBy("block", "line", "span", "nth")
    return rows.withColumn("index", F.row_number().over(order) - 1)


def recovered_chars(chars: DataFrame) -> DataFrame:
    """Characters renumbered by reading geometry, for pages that lack an explicit order."""
    order = W.partitionBy("document", "page_number").orderBy(F.round(geo.edge(F.col("bbox"), 1), 1), geo.edge(F.col("bbox"), 0), "index")
    return chars.withColumn("index", F.row_number().over(order) - 1)


def numbered(pages: DataFrame, column: str) -> DataFrame:
    """Rows of a nested list (drawings, images, annotations) with their place from 0."""
    return pages.select("document", "page_number", F.posexplode(column).alias("index", "item"))


def lines(pages: DataFrame) -> DataFrame:
    """Text lines that aren't empty, as spans, with their place from 0 among all lines."""
    rows = pages.select("document", "page_number", F.posexplode(F.split("native_text", "\n")).alias("line", "text"))
    return rows.where("text <> ''")


def image_coverage(pages: DataFrame) -> DataFrame:
    """(document, page_number, image_coverage, largest_image_coverage) over images distinct by box to 2 digits.

    A page's images may come in several rows. They are dealt out by page before equal ones are dropped,
    so that a task holds the boxes of its pages only, not those of a whole input file.
    """
    rows = pages.repartition("document", "page_number").select("document", "page_number", "width", "height", F.explode("images").alias("i"))
    share = geo.page_coverage(F.col("box"), F.col("width"), F.col("height"))
    boxes = rows.withColumn("box", F.transform("i.bbox", lambda v: F.round(v, 2)))
    boxes = boxes.dropDuplicates(["document", "page_number", "box"]).withColumn("share", share)
    return boxes.groupBy("document", "page_number").agg(
        F.least(F.lit(1.0), F.sum("share")).alias("image_coverage"),
        F.least(F.lit(1.0), F.max("share")).alias("largest_image_coverage"),
    )


def measures(pages: DataFrame) -> DataFrame:
    """Pages with counts, quality and script share of their text."""
    p = F.col("profile")
    rows = pages.withColumn("profile", text.profile(F.col("native_text")))
    measured = rows.withColumns(
        {
            "native_count": p["useful"],
            "quality": text.profile_quality(p),
            "suspicious_count": p["suspicious"],
            "suspicious_tokens": F.when(text.profile_script_ratio(p) >= SCRIPT_GATE, text.noise_count(F.col("native_text"))).otherwise(0),
            "script_ratio": F.round(text.profile_script_ratio(p), 6),
            "suspicious_ratio": F.round(F.when(p["seen"] > 0, p["suspicious"] / p["seen"]).otherwise(0.0), 6),
        }
    )
    return measured.drop("profile")


def trust(count: Column, quality: Column, glyphs: Column, tokens: Column, ratio: Column, regions: Column, largest: Column) -> Column:
    """struct(trust, origin) of a text layer, by the first rule that holds."""
    scan = largest >= SCAN_COVERAGE
    severe = (ratio >= 0.01) | (glyphs >= 8) | (regions >= 4) | (tokens >= 1)
    answer = lambda level, origin: F.struct(F.lit(level).alias("trust"), F.lit(origin).alias("origin"))
    return (
        F.when(scan, answer("low", "scan_like"))
        .when(count == 0, answer("low", "unknown"))
        .when(severe, answer("low", "embedded_ocr_or_corrupt_mapping_likely"))
        .when((glyphs > 0) | (quality < 0.95), answer("medium", "unknown"))
        .when(quality >= 0.98, answer("high", "born_digital_likely"))
        .otherwise(answer("medium", "unknown"))
    )


def mode(count: Column, quality: Column, level: Column, largest: Column, has_image: Column) -> Column:
    poor = (count < MIN_CHARS) | (quality < MIN_QUALITY) | (level == "low")
    return F.when(poor, "ocr_required").when((largest >= LARGE_IMAGE) | has_image, "hybrid").otherwise("native")


def reasons(**named: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named.items()]))


def suspect_lines(pages: DataFrame) -> DataFrame:
    """Lines with suspicious glyphs, or on pages of enough expected script with noise tokens."""
    gate = pages.select("document", "page_number", (text.script_ratio(F.col("native_text")) >= SCRIPT_GATE).alias("gate"), "native_text")
    rows = gate.select("document", "page_number", "gate", F.posexplode(F.split("native_text", "\n")).alias("line", "text"))
    rows = rows.withColumn("glyphs", text.suspicious_count(F.col("text")))
    rows = rows.withColumn("tokens", F.when(F.col("gate"), text.noise_count(F.col("text"))).otherwise(0))
    return rows.where("glyphs > 0 or tokens > 0").select("document", "page_number", "line", "text", "glyphs", "tokens")


def assessed(pages: DataFrame) -> DataFrame:
    """`measures` with suspect_regions, trust, origin and mode; pages without image columns count as bare text."""
    for name in ("image_coverage", "largest_image_coverage"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(0.0))
    measured = measures(pages)
    split = F.split("native_text", "\n")
    hit = lambda x: (text.suspicious_count(x) > 0) | ((F.col("script_ratio") >= SCRIPT_GATE) & (text.noise_count(x) > 0))
    measured = measured.withColumn("suspect_regions", F.size(F.filter(split, hit)))
    names = ("native_count", "quality", "suspicious_count", "suspicious_tokens", "suspicious_ratio", "suspect_regions")
    level = trust(*[F.col(n) for n in names], F.col("largest_image_coverage"))
    measured = measured.withColumn("t", level).withColumns({"trust": F.col("t.trust"), "origin": F.col("t.origin")}).drop("t")
    largest = F.col("largest_image_coverage")
    return measured.withColumn("mode", mode(F.col("native_count"), F.col("quality"), F.col("trust"), largest, F.col("image_coverage") > 0))


def identity(pages: DataFrame, nfkc: bool = True) -> DataFrame:
    """Pages with normalized_text, fingerprints and stable_page_id.

    The id covers rounded size, rotation, text and images, and the drawings only of a page that
    has neither text nor images. `nfkc=False` skips that step for text known to be stable under it.
    """
    for name, kind in (("images", "array<struct<digest:string,bbox:array<double>,width_px:int,height_px:int>>"), ("vector", "string"), ("annotation", "string")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    body = F.coalesce("native_text", F.lit(""))
    rows = pages.withColumn("normalized_text", text.page_text(body) if nfkc else text.collapse(body))
    rows = rows.withColumns(
        {
            "text_fingerprint": hashing.text_hash(F.col("normalized_text")),
            "image_fingerprint": hashing.text_hash(F.to_json(hashing.image_payload(F.coalesce("images", F.array().cast(pages.schema["images"].dataType))))),
            "vector_fingerprint": hashing.text_hash(F.coalesce("vector", F.lit("[]"))),
            "annotation_fingerprint": hashing.text_hash(F.coalesce("annotation", F.lit("[]"))),
        }
    )
    bare = (F.length("normalized_text") == 0) & (F.coalesce(F.size("images"), F.lit(0)) <= 0)
    return rows.withColumn(
        "stable_page_id",
        hashing.payload_hash(
            width=F.round("width", 3),
            height=F.round("height", 3),
            rotation=F.col("rotation"),
            text=F.col("text_fingerprint"),
            image=F.col("image_fingerprint"),
            vector=F.when(bare, F.col("vector_fingerprint")),
        ),
    )
