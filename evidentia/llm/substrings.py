"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes; where its top bits are zero a chunk may end, so cuts
depend on the last WINDOW bytes only and fall alike in every copy of a passage, wherever
insertions have shifted it. Chunks are deduplicated by digest over all documents; the first
place of a digest is its own, later ones repeat it. A run of adjacent chunks that occur elsewhere
too makes a shared passage, which is then extended into the chunks at its ends as far as the text
there equals that of the place it repeats. The first place keeps a passage and later ones lose it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.binding import let
from evidentia.llm.spans import part, pieces
from evidentia.llm.text import bounded, flat, text_key
from evidentia.staging import settle, stage

WINDOW = 32
MIN_BYTES = 24
MAX_BYTES = 192
#: Top bits that are zero at a cut: one place in 16.
CUT_BITS = 4
#: Least length in characters of a passage, and of a run of repeated chunks that is worth extending.
MIN_SPAN = 100
MIN_RUN = 32
#: Characters beyond a run's ends that are compared with those of the place it repeats.
REACH = 256

_GEAR = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 32, 256, np.uint32)


def _cut_places(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) at which a chunk may stop: the rolling hash of the WINDOW bytes before them cuts there."""
    rolling = _GEAR[data]
    width = 1
    while width < WINDOW:  # hash of 2w bytes from two hashes of w bytes
        wider = rolling.copy()
        wider[width:] += rolling[:-width] << np.uint32(width)
        rolling, width = wider, width * 2
    cut = rolling < np.uint32(1 << (32 - CUT_BITS))
    cut[:-1] &= (data[1:] & 0xC0) != 0x80  # never inside a character
    return np.flatnonzero(cut) + 1


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For each text in the concatenated `data` the ends of its chunks, as places in `data`."""
    cuts = _cut_places(data)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        first, last = np.searchsorted(cuts, (lo + WINDOW, hi))
        ends, start = [], lo
        for cut in [*cuts[first:last].tolist(), hi]:
            while cut - start > MAX_BYTES:
                start += MAX_BYTES
                while start < cut and data[start] & 0xC0 == 0x80:
                    start += 1
                if start < cut:
                    ends.append(start)
            if cut - start >= MIN_BYTES or cut == hi and cut > start:
                ends.append(cut)
                start = cut
        yield ends


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, key, nth, start, stop, final, digest): all chunks of whole texts, start and stop in code points.

    key is a digest of the text: with doc_id it tells documents apart, and rows equal in both are one
    document. final says of a text's last chunk that it is that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 2 << 20):
            data, offsets = flat(batch.column("text"))
            if not len(data):
                continue
            view, points = memoryview(data), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            rows, nths, starts, stops, finals = [], [], [], [], []
            for row, ends in enumerate(chunk_ends(data, offsets)):
                rows += [row] * len(ends)
                nths += range(len(ends))
                starts += [int(offsets[row]), *ends[:-1]] if ends else []
                stops += ends
                finals += [False] * (len(ends) - 1) + [True] if ends else []
            digests = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts, stops, strict=True)]
            base, own = points[offsets[:-1]][rows], pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(own),
                    batch.column("key").take(own),
                    pa.array(nths, pa.int32()),
                    pa.array(points[starts] - base, pa.int32()),
                    pa.array(points[stops] - base, pa.int32()),
                    pa.array(finals, pa.bool_()),
                    pa.array(np.array(digests, np.uint64).view(np.int64)),
                ],
                ["doc_id", "key", "nth", "start", "stop", "final", "digest"],
            )

    source = _identified(docs).where("text is not null")
    return source.mapInArrow(run, "doc_id long, key long, nth int, start int, stop int, final boolean, digest long")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))


def _place(*fields: str) -> Column:
    """A place in the corpus, in order: by doc_id, rows without one last, then by text and place in it."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", *fields)


def _runs(docs: DataFrame) -> DataFrame:
    """Chunks that occur elsewhere too, in runs of neighbours: (doc_id, key, run, nth, start, stop, digest, size, chars, first_nth, last_nth)."""
    found = stage(chunks(docs), "chunks").withColumn("size", F.col("stop") - F.col("start"))
    place = F.xxhash64("doc_id", "key", "nth")  # equal rows are one document: their chunks don't repeat each other
    held = found.groupBy("digest", "size").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    repeated = stage(held.where("a <> b").select("digest", "size"), "repeated")
    hits = found.join(repeated, ["digest", "size"])
    # neighbours make a run: their places less their ranks are equal
    hits = hits.withColumn("run", F.col("nth") - F.dense_rank().over(W.partitionBy("doc_id", "key").orderBy("nth")))
    whole = W.partitionBy("doc_id", "key", "run")
    chars = F.max("stop").over(whole) - F.min("start").over(whole)
    hits = hits.withColumns({"chars": chars, "first_nth": F.min("nth").over(whole), "last_nth": F.max("nth").over(whole)})
    return hits.where(F.col("chars") >= MIN_RUN)


def _others(hits: DataFrame) -> DataFrame:
    """First and last chunks of runs, each with another place of its digest as `other`: the first place, or the last for that.

    Where a run reaches an end of its text there is nothing to extend it into.
    """
    ends = hits.where("(nth = first_nth and start > 0) or (nth = last_nth and not final)")
    place = _place("nth", "start", "stop")
    held = hits.groupBy("digest", "size").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    ends = ends.join(stage(held, "places"), ["digest", "size"])
    own = (F.col("first.nth") == F.col("nth")) & (F.col("first.key") == F.col("key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    return stage(ends.withColumn("other", F.when(own, F.col("last")).otherwise(F.col("first"))), "ends")


def _context(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, key, at, ahead, near) for each wanted (doc_id, key, at, ahead): REACH characters before a place, or those after it backwards."""
    places = wanted.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "ahead")).alias("places"))
    places = stage(places, "places").withColumnsRenamed({"doc_id": "p_doc", "key": "p_key"})
    same = F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("key") == F.col("p_key"))
    texts = _identified(docs).where("text is not null").join(places, same).select("doc_id", "key", "text", "places")
    near = lambda held, w: F.when(w["ahead"], F.reverse(part(held, w["at"], F.least(w["at"] + REACH, F.col("size"))))).otherwise(
        part(held, F.greatest(w["at"] - REACH, F.lit(0)), w["at"])
    )
    around = lambda held: F.transform("places", lambda w: F.struct(w["at"].alias("at"), w["ahead"].alias("ahead"), near(held, w).alias("near")))
    found = texts.withColumn("size", F.length("text")).select("doc_id", "key", F.explode(let(pieces(F.col("text")), around)).alias("c"))
    return found.select("doc_id", "key", "c.*").dropDuplicates(["doc_id", "key", "at", "ahead"])  # equal rows are one document


def _shared_end(a: str, b: str) -> Column:
    """Number of equal characters at the ends of two texts of REACH characters at most, by halving."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    steps = F.array(*[F.lit(REACH >> k) for k in range(REACH.bit_length())])
    alike = lambda n: (F.length(a) >= n) & (F.length(b) >= n) & (F.right(a, n) == F.right(b, n))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(alike(n + step), n + step).otherwise(n))


def passages(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """Chunks of passages (doc_id, key, run, nth, start, stop, digest, size, first): runs extended to their true bounds.

    The first and last chunk of a run also hold the characters by which it was extended. Passages
    of under `min_span` characters are left out.
    """
    hits = settle(docs.sparkSession, partial(_runs, docs), "hits")
    ends = _others(hits)
    at = lambda side, place, field: F.struct(
        F.lit(side).alias("side"), F.col(f"{place}doc_id").alias("doc_id"), F.col(f"{place}key").alias("key"), F.col(f"{place}{field}").alias("at"), F.lit(field == "stop").alias("ahead")
    )
    both = lambda edge, field: F.array(at(f"own_{edge}", "", field), at(f"other_{edge}", "other.", field))
    wanted = F.concat(
        F.when((F.col("nth") == F.col("first_nth")) & (F.col("start") > 0), both("a", "start")).otherwise(F.array()),
        F.when((F.col("nth") == F.col("last_nth")) & ~F.col("final"), both("z", "stop")).otherwise(F.array()),
    )
    asked = stage(ends.select(F.struct("doc_id", "key", "run").alias("id"), F.explode(wanted).alias("w")).select("id", "w.*"), "asked")
    told = stage(_context(docs, asked.select("doc_id", "key", "at", "ahead")), "contexts")
    told = told.withColumnsRenamed({"doc_id": "t_doc", "key": "t_key", "at": "t_at", "ahead": "t_ahead"})
    same = F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("key") == F.col("t_key")) & (F.col("at") == F.col("t_at")) & (F.col("ahead") == F.col("t_ahead"))
    told = asked.join(told, same).select("id", "side", "near")
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("near")))
    sides = told.groupBy("id").agg(*[side(n).alias(n) for n in ("own_a", "other_a", "own_z", "other_z")])
    grown = sides.select("id.*", _shared_end("own_a", "other_a").alias("more_a"), _shared_end("own_z", "other_z").alias("more_z"))
    grown = stage(grown, "grown").withColumnsRenamed({"doc_id": "g_doc", "key": "g_key", "run": "g_run"})
    same = F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("key") == F.col("g_key")) & (F.col("run") == F.col("g_run"))
    rows = hits.join(grown, same, "left").fillna(0, ["more_a", "more_z"])
    rows = rows.withColumn("chars", F.col("chars") + F.col("more_a") + F.col("more_z")).where(F.col("chars") >= min_span)
    more = lambda edge, by: F.when(F.col("nth") == F.col(edge), F.col(by)).otherwise(0)
    return rows.select(
        "doc_id", "key", "run", "nth", (F.col("start") - more("first_nth", "more_a")).alias("start"), (F.col("stop") + more("last_nth", "more_z")).alias("stop"), "digest", "size"
    )


def shared_spans(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, key, start, stop, kept): passages of `min_span` characters or more that occur elsewhere too.

    Elsewhere is another document or another place of the same one. `min_span` is asked of a passage
    as a whole, which is then split where its chunks' fates change. kept is true where this is the
    first place of the part in any passage: places go by doc_id, those without a doc_id last, then by
    the text's digest and the place in it. A digest goes with its chunk's length; a chance collision
    of 64 bits would have to befall chunk after chunk to matter. Null texts have none; rows equal in
    doc_id and text are one document; texts that differ are told apart even under one doc_id.
    """
    hits = settle(docs.sparkSession, partial(passages, docs, min_span), "passages")
    keepers = stage(hits.groupBy("digest", "size").agg(F.min(_place("nth")).alias("keeper")), "keepers")
    kept = (F.col("keeper.nth") == F.col("nth")) & (F.col("keeper.key") == F.col("key")) & F.col("keeper.doc_id").eqNullSafe(F.col("doc_id"))
    hits = hits.join(keepers, ["digest", "size"]).select("doc_id", "key", "run", "nth", "start", "stop", kept.alias("kept"))
    part = F.col("nth") - F.dense_rank().over(W.partitionBy("doc_id", "key", "run", "kept").orderBy("nth"))
    parts = hits.withColumn("part", part).groupBy("doc_id", "key", "run", "kept", "part")
    return parts.agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("doc_id", "key", "start", "stop", "kept")


def shared_documents(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """A row for each document with shared spans: doc_id, n_spans, shared_chars, removed_chars, spans.

    spans lists start:stop of each, in order, those that go with a minus sign before them. Texts
    that differ are documents of their own, with a row each, even under one doc_id or without one.
    """
    size = F.col("stop") - F.col("start")
    label = F.concat(F.when(F.col("kept"), "").otherwise("-"), F.concat_ws(":", "start", "stop"))
    return (
        shared_spans(docs, min_span)
        .groupBy("doc_id", "key")
        .agg(
            F.count("*").alias("n_spans"),
            F.sum(size).alias("shared_chars"),
            F.sum(F.when(F.col("kept"), 0).otherwise(size)).alias("removed_chars"),
            F.array_sort(F.collect_list(F.struct("start", "stop", label.alias("label")))).alias("listed"),
        )
        .withColumn("spans", F.array_join(F.transform("listed", lambda s: s["label"]), ","))
        .drop("listed", "key")
    )


def deduplicate(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """`docs` without the spans that an earlier place keeps, all columns and rows as they were otherwise."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        done = []
        for batch in bounded([pa.RecordBatch.from_arrays([texts, spans], ["text", "gone"])], "text"):
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                at, parts = 0, []
                for s in sorted(gone, key=lambda s: s["start"]):
                    parts.append(text[at : s["start"]])
                    at = max(at, s["stop"])
                out.append("".join([*parts, text[at:]]))
            done.append(pa.array(out, pa.string()))
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    gone = shared_spans(docs, min_span).where("not kept")
    gone = stage(gone.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("gone")), "gone")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("own"), F.struct("*").alias("row"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("key")), "left").select("row", "gone")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        cut(F.coalesce("row.text", F.lit("")), F.coalesce("gone", F.array().cast("array<struct<start:int,stop:int>>")))
    )
    return rows.select("row", text.alias("t")).select(F.col("row").withField("text", F.col("t")).alias("row")).select("row.*")
