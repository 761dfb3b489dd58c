"""Text recognition by an injected engine: targets in Arrow batches, cached answers reused, failures as rows.

An engine is any object with `name`, `settings` (a mapping that its answers depend on) and
`recognise(image) -> list of (text, confidence, box in pixels or None)`. A factory makes it once for
each task, where a model would be loaded; no model comes with this package.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import geometry as geo
from evidentia.functions.hashing import text_hash
from evidentia.operators.state import with_cache

LINE = "struct<text:string,confidence:double,bbox:array<double>>"
_LINES = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.float64()))]))
#: Targets that are recognised before their answers are handed on.
BATCH = 32


class Engine(Protocol):
    """What recognises text in an image."""

    name: str
    settings: Mapping[str, object]

    def recognise(self, image: bytes) -> Sequence[tuple[str, float, Sequence[float] | None]]: ...


def backend_signature(engine: Engine) -> str:
    """Name and settings of an engine as JSON with sorted keys; answers of equal signatures may stand for one another."""
    return json.dumps({"engine": engine.name, "settings": dict(engine.settings)}, sort_keys=True, ensure_ascii=False)


def recognise(targets: DataFrame, engine: Callable[[], Engine] | None) -> DataFrame:
    """Targets (target_id, cache_key, image, …) with status, error, lines, text and confidence; the image is dropped.

    status is completed, failed (with the error of that target alone) or, without an engine,
    not_executed_no_backend. text joins the lines; confidence is their mean. A null image fails.
    """
    rest = [c for c in targets.columns if c != "image"]
    answer = f"status string, error string, lines array<{LINE}>"
    if engine is None:
        lines = F.lit(None).cast(f"array<{LINE}>")
        found = targets.select(*rest, F.lit("not_executed_no_backend").alias("status"), F.lit(None).cast("string").alias("error"), lines.alias("lines"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for whole in batches:
                for lo in range(0, whole.num_rows, BATCH):
                    batch, answers = whole.slice(lo, BATCH), []
                    for image in batch.column("image").to_pylist():
                        held = held or engine()
                        try:
                            if image is None:
                                raise ValueError("no image")
                            lines = [{"text": t, "confidence": float(c), "bbox": None if b is None else [float(x) for x in b]} for t, c, b in held.recognise(image)]
                            answers.append(("completed", None, lines))
                        except Exception as error:  # of the engine, whatever it raises: this target's alone
                            answers.append(("failed", f"{type(error).__name__}: {error}", None))
                    columns = [pa.array([a[k] for a in answers], kind) for k, kind in enumerate((pa.string(), pa.string(), _LINES))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, "status", "error", "lines"])

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema if f.name != "image")
        found = targets.select(*rest, "image").mapInArrow(run, f"{kept}, {answer}")
    joined = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    total = F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["confidence"])
    return found.withColumns({"text": F.when(F.size("lines") > 0, joined), "confidence": F.when(F.size("lines") > 0, total / F.size("lines"))})


def read_through(targets: DataFrame, cache: DataFrame, engine: Callable[[], Engine] | None) -> tuple[DataFrame, DataFrame]:
    """(answers, additions): targets (target_id, cache_key, image) answered from the cache where it can, else by the engine.

    The cache has cache_key, text, confidence and lines; a row is only believed if its text is the text
    of its lines, and else recomputed. Targets of one key are executed once. additions are the rows to
    append to the cache.
    """
    whole = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    sound = cache.where(F.coalesce(whole == F.col("text"), F.lit(False)))
    _, left = with_cache(targets, sound)
    fresh = recognise(left.groupBy("cache_key").agg(F.min_by("target_id", "target_id").alias("target_id"), F.min_by("image", "target_id").alias("image")), engine)
    names = ("cache_key", "status", "error", "text", "confidence", "lines")
    reused = sound.dropDuplicates(["cache_key"]).select("cache_key", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), "text", "confidence", "lines", F.lit(True).alias("reused"))
    known = reused.unionByName(fresh.select(*names, F.lit(False).alias("reused")))
    additions = fresh.where("status = 'completed' and text is not null").select("cache_key", "text", "confidence", "lines")
    return targets.drop("image").join(known, "cache_key"), additions


def placed(lines: Column, pixel_map: Column) -> Column:
    """Lines with pdf_bbox, their box on the page under a crop's map (see routing.pixel_map)."""
    return F.transform(lines, lambda x: x.withField("pdf_bbox", F.when(x["bbox"].isNotNull(), geo.affine(x["bbox"], pixel_map))))


def image_key(image: Column) -> Column:
    """Hash of an image's bytes, part of a target's cache key."""
    return text_hash(image)
