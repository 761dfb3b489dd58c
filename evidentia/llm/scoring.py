"""Cross-entropy difference between a target and a background language model.

All models are word bigram models over one vocabulary, every word of all documents. The target
model counts the documents labelled good. The background model is its match: as many tokens, of
other documents chosen by hash. A third model counts all documents. Scores are held out: what a
document itself adds to a model is taken away before its tokens are scored. A document's score is
the mean of background loss less target loss, so that it is high where the target explains a text
better; its loss under the model of all documents says how much of it the rest of the corpus holds.

The counts are a table that grows with the corpus and is never gathered in one place. Texts
are read once, into chunks of some MB whose tokens are numbered within the chunk. A chunk asks
for each word, context and pair that it holds once, however often it holds it, so that a hot
pair has no more rows than there are chunks. Requests go by digest to buckets, which add them
up and answer in the order asked; a chunk with its answers is scored alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.text import bounded, mixed
from evidentia.staging import stage

#: Weight of the unigram model in a bigram estimate, in counts, and what is added to each unigram count.
BACKOFF = 100.0
ADDED = 0.5
_WORD = re.compile(r"\w+")
#: Characters of text after which a chunk ends; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Tokens of the corpus to a bucket: the fewest while there are under BUCKETS of them, and the most.
FEWEST, MOST = 1 << 13, 1 << 22
BUCKETS = 1_024
SIDES = ("corpus", "target", "background")
#: Digest of a text's beginning, and what tells words, contexts and pairs apart in two low bits.
_BEGIN = np.uint64(0x9E3779B97F4A7C15)
_OWN, _CONTEXT, _PAIR = (np.uint64(k) for k in range(3))


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True) + len(numbers).to_bytes(8, "little")


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(data[-8:], "little")
    planes = np.frombuffer(pa.decompress(data[:-8], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, doc_ids, sizes, draws, words, tokens, n): each row of `docs` in one chunk, with its count of tokens.

    A text's draw is a digest of it and its doc_id, by which it may be chosen for a sample; words holds digests of the chunk's distinct words, tokens the place of each token's word there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId() << 32, 0
        places, ids, sizes, draws, tokens, held = {}, [], [], [], [], 0

        def out() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in places), np.uint64, len(places))
            own = np.concatenate(tokens)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64())
            row = (task + nth, ids, sizes, draws, words.tobytes(), _packed(own), len(own))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in bounded(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = _WORD.findall(text.lower()) if text else []
                ids.append(doc_id)
                sizes.append(len(found))
                draws.append(xxhash.xxh3_64_intdigest((text or "").encode(), (doc_id or 0) & (1 << 64) - 1) >> 33)
                tokens.append(np.fromiter((places.setdefault(w, len(places)) for w in found), np.int64, len(found)))
                held += len(text or "")
                if held >= CHUNK:
                    yield out()
                    places, ids, sizes, draws, tokens, held, nth = {}, [], [], [], [], 0, nth + 1
        if ids:
            yield out()

    names = ["chunk", "doc_ids", "sizes", "draws", "words", "tokens", "n"]
    schema = "chunk long, doc_ids array<long>, sizes array<int>, draws array<int>, words binary, tokens binary, n long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Held:
    """What a chunk holds: keys of words, then of contexts, then of pairs, and the order in which they are asked for."""

    def __init__(self, row: dict) -> None:
        words, self.sizes = np.frombuffer(row["words"], np.uint64), np.array(row["sizes"], np.int64)
        self.own, self.n_words = _unpacked(row["tokens"]), len(words)
        self.before = np.empty_like(self.own)
        self.before[1:] = self.own[:-1]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = self.n_words  # a text's beginning
        pairs, self.pair = np.unique(self.before * (self.n_words + 1) + self.own, return_inverse=True)
        self.first, self.second = np.divmod(pairs, self.n_words + 1)
        known = np.append(words, _BEGIN)
        both = mixed(mixed(known[self.first]) + known[self.second])
        kinds = ((words, _OWN), (known, _CONTEXT), (both, _PAIR))
        self.keys = np.concatenate([mixed(x) & ~np.uint64(3) | kind for x, kind in kinds])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, chosen: np.ndarray | slice) -> np.ndarray:
        """How often the `chosen` tokens hold each key."""
        sides = ((self.own, self.n_words), (self.before, self.n_words + 1), (self.pair, len(self.first)))
        return np.concatenate([np.bincount(x[chosen], minlength=n) for x, n in sides])

    def own_counts(self) -> list[np.ndarray]:
        """For each token how often its own text holds its word, its context and its pair."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        held = []
        for side, n in ((self.own, self.n_words), (self.before, self.n_words + 1), (self.pair, len(self.first))):
            _, place, times = np.unique(text * n + side, return_inverse=True, return_counts=True)
            held.append(times[place])
        return held

    def bits(self, counts: np.ndarray, tokens: int, words: int, inside: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
        """Each text's sum of losses under a model of `counts`, which are of these keys.

        `inside` says which texts the model has counted: it is asked without what the text itself
        added, which is what `own_counts` gives.
        """
        ahead, contexts, pairs = np.split(counts, [self.n_words, 2 * self.n_words + 1])
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        less = inside[text]
        word, context, pair = (x * less for x in own)
        unigram = (ahead[self.own] - word + ADDED) / (tokens - (self.sizes * inside)[text] + ADDED * words)
        seen, after = pairs[self.pair] - pair, contexts[self.before] - context
        lost = -np.log2((seen + BACKOFF * unigram) / (after + BACKOFF))
        return np.bincount(text, weights=lost, minlength=len(self.sizes))


def members(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk, target, background): places of each chunk's texts that are of the target, and of its match.

    Other documents are chosen for the match by their draw, at the rate of the target's tokens to theirs.
    """
    texts = held.select("chunk", F.posexplode(F.arrays_zip("doc_ids", "sizes", "draws")).alias("place", "t")).select("chunk", "place", "t.*")
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good")).distinct()
    # labels grow with the documents, so they are never broadcast; ids are shuffled to them, not texts
    told = texts.join(good.hint("merge"), texts.doc_ids == good.good, "left").select("chunk", "place", "sizes", "draws", F.col("good").isNotNull().alias("target"))
    told = stage(told, "members")
    sums = told.agg(F.sum(F.when(F.col("target"), F.col("sizes"))).alias("good"), F.sum(F.when(~F.col("target"), F.col("sizes"))).alias("other")).first()
    rate = min(1.0, (sums.good or 0) / sums.other) if sums.other else 0.0
    chosen = ~F.col("target") & (F.col("draws") < F.lit(rate * (1 << 31)))
    of = lambda test: F.collect_list(F.when(test, F.col("place")))
    return stage(told.groupBy("chunk").agg(of(F.col("target")).alias("target"), of(chosen).alias("background")), "places")


def _flags(places: pa.Table, side: str, n: int) -> np.ndarray:
    """1 for each of a chunk's `n` texts that is of the side, else 0."""
    found = np.zeros(n, np.int64)
    for own in places.column(side).to_pylist():
        found[own] = 1
    return found


def requests(held: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, keys, corpus, target, background): each chunk's keys and own counts, a row for each bucket it needs.

    `places` says which of a chunk's texts are of which model; `buckets` is a power of 2.
    """
    width = buckets.bit_length() - 1

    def run(chunk: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        for row in chunk.to_pylist():
            found = _Held(row)
            keys = found.keys[found.order]
            chosen = (slice(None), *(np.repeat(_flags(own, side, len(found.sizes)) > 0, found.sizes) for side in SIDES[1:]))
            sides = [found.counts(x)[found.order] for x in chosen]
            edges = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - width)) if width else []
            ends = [0, *np.asarray(edges).tolist(), len(keys)]
            for bucket, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if a < b:
                    gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                    rows.append((bucket, row["chunk"], _packed(gaps), *[_packed(x[a:b]) for x in sides]))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.Table.from_arrays(columns, ["bucket", "chunk", "keys", *SIDES])

    sides = held.groupBy("chunk").cogroup(places.groupBy("chunk"))
    return sides.applyInArrow(run, "bucket int, chunk long, keys binary, corpus binary, target binary, background binary")


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, bucket, corpus, target, background, words, n_...): sums over all chunks, in the order each asked.

    words are the bucket's distinct words, n_... their counts by model, in one of its rows and 0 in others.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        word = distinct & np.uint64(3) == _OWN
        sums, packed = [int(word.sum())], []
        for side in SIDES:
            own = np.concatenate([_unpacked(x) for x in table.column(side).to_pylist()])
            total = np.bincount(place, weights=own, minlength=len(distinct)).astype(np.int64)  # exact below 2^53
            sums.append(int(total[word].sum()))
            packed.append(pa.array([_packed(x) for x in np.split(total[place], cuts)], pa.binary()))
        once = [pa.array([x] + [0] * (len(keys) - 1), pa.int64()) for x in sums]
        names = ["chunk", "bucket", *SIDES, "words", *(f"n_{x}" for x in SIDES)]
        return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), *packed, *once], names)

    schema = "chunk long, bucket int, corpus binary, target binary, background binary, words long, n_corpus long, n_target long, n_background long"
    return asked.groupBy("bucket").applyInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_bits, background_bits, corpus_bits, score) for every row of `docs` (doc_id, text).

    `labels` (doc_id, quality) names the target: documents with a label of quality 1. Bits are means
    over tokens; score is background_bits less target_bits. A text without tokens, null or empty, has
    null figures. Without a target, or without other documents, all three models are that of all
    documents and every score is 0. A document labelled twice is good if any label says so; rows that
    repeat a doc_id share its label and are each held out alone, rows without one have none; columns
    but these aren't read, whatever their names.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = stage(chunks(source), "chunks")
    places = members(held, labels)
    tokens = held.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << (max(min(tokens // FEWEST, BUCKETS), tokens // MOST, 1) - 1).bit_length()
    told = stage(answers(requests(held, places, buckets)), "answers")
    sums = told.agg(*[F.sum(c).alias(c) for c in ("words", *(f"n_{x}" for x in SIDES))]).first().asDict()
    used = SIDES if sums["n_target"] and sums["n_background"] else ("corpus",) * 3
    # a chunk's places come along in one more row of its answers
    told = told.select("chunk", "bucket", *[F.col(x).alias(f"of_{x}") for x in SIDES])
    told = told.unionByName(places.withColumn("bucket", F.lit(-1)), allowMissingColumns=True)

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        found, parts = found.sort_by("bucket"), []
        is_answer = pc.greater_equal(found.column("bucket"), 0)
        own, found = found.filter(pc.invert(is_answer)), found.filter(is_answer)
        for row in chunk.to_pylist():
            asked, means = _Held(row), {}
            added, sizes = asked.own_counts(), np.maximum(asked.sizes, 1)
            for side in set(used):
                inside = _flags(own, side, len(sizes)) if side != "corpus" else np.ones(len(sizes), np.int64)
                counts = np.empty(len(asked.keys), np.int64)
                counts[asked.order] = np.concatenate([_unpacked(x) for x in found.column(f"of_{side}").to_pylist()])
                means[side] = asked.bits(counts, sums[f"n_{side}"], sums["words"], inside, added) / sizes
            corpus, target, background = (means[x] for x in used)
            figures = [pa.array(x, pa.float64(), mask=asked.sizes == 0) for x in (target, background, corpus, background - target)]
            parts.append(pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(asked.sizes), *figures], names))
        return pa.concat_tables(parts) if parts else pa.schema(zip(names, kinds, strict=True)).empty_table()

    names = ["doc_id", "n_tokens", "target_bits", "background_bits", "corpus_bits", "score"]
    kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
    sides = held.groupBy("chunk").cogroup(told.groupBy("chunk"))
    return sides.applyInArrow(run, "doc_id long, n_tokens long, target_bits double, background_bits double, corpus_bits double, score double")
