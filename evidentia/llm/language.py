"""Language identification by compression: the dictionary that encodes a text shortest names its language.

A zstandard raw-content dictionary for each language holds text of that language. Texts are
encoded block by block, so that a dictionary stays in reach through long texts, with each
dictionary in turn; the smallest total wins, and a narrow margin to the next marks the
answer as not accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.text import bounded, text_key
from evidentia.staging import stage

#: Bound of the sample a language's dictionary is made of: rows at most, and bytes after which no further row is taken.
SAMPLE_ROWS = 64
DICTIONARY_BYTES = 65_536
#: Rows of more characters are taken only where a language's shorter ones don't fill its dictionary.
LONG_ROW = 16_384
#: Languages whose dictionaries a worker holds at once; of more, texts meet one set after another.
LANGUAGES = 128
BLOCK_BYTES = 4_096
LEVEL = 6
#: Least share by which the second smallest size must exceed the smallest for an answer to be accepted.
MARGIN = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Dictionary content for each language of `labelled` (doc_id, text, lang): at most `rows` whole rows each.

    One row is chosen for each of `rows` hash classes of a language, a shorter one before one of over
    LONG_ROW characters, then the smallest hash. They are joined in that order until DICTIONARY_BYTES
    are reached, so content doesn't depend on how the table is dealt. Rows without a text, a language
    or a doc_id teach nothing; rows that repeat count once.
    """
    known = labelled.where("doc_id is not null and lang is not null and text is not null")
    order = F.struct((F.length("text") > LONG_ROW).alias("long"), F.xxhash64("doc_id", F.lit("language")).alias("h"), text_key().alias("key"))
    known = known.select("lang", F.col("text").cast("string").alias("text"), order.alias("rank"))
    least = stage(known.groupBy("lang", F.pmod("rank.h", F.lit(rows)).alias("class")).agg(F.min("rank").alias("rank")), "chosen")
    picked = known.join(least, ["lang", "rank"], "left_semi").orderBy("lang", "rank")
    found: dict[str, bytes] = {}
    last = None
    for r in picked.toLocalIterator():
        fresh = (r.lang, r.rank) != last
        if fresh and len(found.get(r.lang, b"")) < DICTIONARY_BYTES:
            found[r.lang] = found.get(r.lang, b"") + r.text.lower().encode() + b"\n"
        last = (r.lang, r.rank)
    return found


@lru_cache(maxsize=4)
def _compressors(content: tuple[tuple[str, bytes], ...], level: int) -> dict[str, zstandard.ZstdCompressor]:
    found = {}
    for name, data in content:
        held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        found[name] = zstandard.ZstdCompressor(
            dict_data=held, level=level, write_content_size=False, write_checksum=False, write_dict_id=False
        )
    return found


def sizes(text: str | None, content: tuple[tuple[str, bytes], ...]) -> list[tuple[int, str]]:
    """(bytes, language) of a text in lower case, encoded block by block with each dictionary; none for a text without letters."""
    if not text or not _LETTER.search(text):
        return []
    data = text.lower().encode()
    return [
        (sum(len(c.compress(data[i : i + BLOCK_BYTES])) for i in range(0, len(data), BLOCK_BYTES)), name)
        for name, c in _compressors(content, LEVEL).items()
    ]


def predict(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for every row of `docs` (doc_id, text), whole texts.

    score is 0 at a tie and nears 1 as the second language needs ever more bytes than the first; with
    one language it is 1. Ties go to the first language by name. A null text, one without letters, or
    nothing learned give `und` and 0. A null doc_id stays null; repeated rows each get a row; columns
    but doc_id and text aren't read. Of more than LANGUAGES languages one set is tried after another,
    in the same pass over the texts; the two smallest sizes go along.
    """
    fixed = sorted(content.items())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    two = "array<struct<size:long,name:string>>"
    rows = source.withColumn("best", F.array().cast(two))
    for lo in range(0, len(fixed), LANGUAGES):
        rows = rows.mapInArrow(_tried(docs.sparkSession.sparkContext.broadcast(tuple(fixed[lo : lo + LANGUAGES]))), f"doc_id long, text string, best {two}")
    first, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    score = F.when(first.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(1 - first["size"] / second["size"])
    rows = rows.select("doc_id", F.coalesce(first["name"], F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))
    return rows.withColumn("accepted", F.col("score") >= MARGIN)


def _tried(shared):
    """The two smallest of the sizes that came along and of those by one set of dictionaries."""
    kind = pa.list_(pa.struct([("size", pa.int64()), ("name", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            best = []
            for text, before in zip(batch.column("text").to_pylist(), batch.column("best").to_pylist(), strict=True):
                found = sorted(sizes(text, shared.value) + [(x["size"], x["name"]) for x in before])[:2]
                best.append([{"size": n, "name": name} for n, name in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(best, kind)], ["doc_id", "text", "best"])

    return run


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's digits, modulo 3, is 1. A null id isn't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
