"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a digest of the row. A source's target is filled by whole
passes over its blocks and then by single blocks in permuted order, each taken if it still
fits; where blocks are too coarse for the target, one more is taken in part. These block draws
are exact quotas; a binary tree over the output shards splits the vector of all sources' quotas
by multivariate-hypergeometric draws until each shard holds its own, and shard after shard takes
the next draws of each source's permuted order, so shards are disjoint. Rows are then shuffled
inside a shard by sorting on a local key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.llm.text import bounded, row_key, word_counts
from evidentia.staging import stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
#: Blocks a source is cut into at most; so many rows a source are ever brought together.
BLOCKS = 4096
SHARDS = 16
#: Orders tried at most for a source, and the share of a target that may be missed without taking a block in part.
ORDERS = 64
CLOSE = 0.002
SEED = 42
#: Sources whose quotas are split together; more are split between groups of so many first.
SOURCES = 65_536
#: Draws are broadcast to rows with their texts up to so many, and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, block, size) for every row; size counts runs of non-space characters, 0 for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            counts = pa.array(word_counts(batch.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), counts], [*names, "size"])

    names = ["doc_id", "source", "block"]
    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _block(docs, seed).alias("block"), F.col("text").cast("string").alias("text")
    )
    return picked.mapInArrow(run, "doc_id long, source string, block int, size long")


def _block(docs: DataFrame, seed: int) -> Column:
    return F.pmod(F.xxhash64(row_key(docs), F.lit(seed)), F.lit(BLOCKS)).cast("int")


def _numbered(totals: DataFrame) -> DataFrame:
    """(source, source_size, nth): sources in order of code points, null last, numbered from 0 by ranges."""
    ranged = totals.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "totals")
    held = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())  # a row a partition
    starts = np.cumsum([0, *(n for _, n in held)]).tolist()
    before = totals.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(held, starts, strict=False)], "part int, before long")
    nth = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    return ranged.join(F.broadcast(before), "part").select("source", "source_size", (nth + F.col("before")).alias("nth"))


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_PASSES) -> DataFrame:
    """`sources` (nth, source_size, ...) with target: `share` of all words by weight, at most `most` times its own, the excess reshared.

    Targets are a common level times the weight. Sources that a level fills are set aside, which
    raises the level for the others, until it fills no more.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    held = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most))
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * level > F.col("most")
        sums = held.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("set_aside"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.count_if(full).alias("full"),
        ).first()
        if not sums.weights or sums.full == n_full:
            break
        level, n_full = max(0.0, share * sums.words - sums.set_aside) / sums.weights, sums.full
    return held.withColumn("target", F.least("most", F.col("weight") * level)).drop("weight", "most")


def split_quotas(quotas: np.ndarray, shards: int | np.ndarray, seed: int = SEED) -> np.ndarray:
    """Quotas [source, shard]: rows sum to `quotas`, columns to the shards' totals, by default alike within one.

    A node of the tree halves its shards and draws the left half's vector without replacement.
    """
    total = int(quotas.sum())
    if isinstance(shards, int):
        shards = np.array([total * (k + 1) // shards - total * k // shards for k in range(shards)], np.int64)
    out = np.zeros((len(quotas), len(shards)), np.int64)

    def divide(node: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = node
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(node, int(shards[lo:mid].sum()), method="marginals") if node.sum() else node
        divide(left, lo, mid)
        divide(node - left, mid, hi)

    if len(quotas):
        divide(quotas.astype(np.int64), 0, len(shards))
    return out


def _shard_ends(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """(nth, ends): how many of a source's draws the shards up to each take."""
    quotas = drawn.groupBy("nth").agg(F.sum("times").alias("n")).withColumn("set", F.floor(F.col("nth") / SOURCES))
    quotas = stage(quotas, "quotas")
    sets = sorted((r["set"], r.n) for r in quotas.groupBy("set").agg(F.sum("n").alias("n")).collect())  # one row for SOURCES sources
    parts = split_quotas(np.array([n for _, n in sets], np.int64), shards, seed)
    leaves = drawn.sparkSession.createDataFrame([(k, row.tolist()) for (k, _), row in zip(sets, parts, strict=True)], "set long, leaves array<long>")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        own = split_quotas(rows["n"].to_numpy(), np.array(rows["leaves"].iloc[0], np.int64), seed + 1 + int(rows["set"].iloc[0]))
        return pd.DataFrame({"nth": rows["nth"], "ends": np.cumsum(own, axis=1).tolist()})

    return quotas.join(F.broadcast(leaves), "set").groupBy("set").applyInPandas(split, "nth long, ends array<long>")


def _extra_pass(words: list[int], rest: float, near: bool = True) -> tuple[float, list[int]]:
    """Blocks to take once more, in order, each if it still fits, and what rests; `near` also takes the one that brings the sum nearest."""
    extra = []
    for size in words:
        extra.append(int(0 < size <= rest))
        rest -= size * extra[-1]
    found = min(((abs(rest - w), i) for i, w in enumerate(words) if near and w and not extra[i]), default=(rest, -1))
    if found[0] < rest:
        rest, extra[found[1]] = found[0], 1
    return rest, extra


def _fill(blocks: pd.DataFrame) -> pd.DataFrame:
    """Draws of each block of one source (at most BLOCKS rows): whole passes, a part, and their place in the source's order.

    Orders are drawn anew, from seeds of their own, until a target is met closely. A source of many
    blocks meets it at once; one of a few large ones that no order meets takes one more in part.
    """
    blocks = blocks.sort_values(["rank", "block"], ignore_index=True)
    total, target = int(blocks["words"].sum()), float(blocks["target"].iloc[0])
    passes, rest = divmod(target, total) if total else (0, 0.0)
    rest, tries = rest if passes < MAX_PASSES else 0.0, []
    words = blocks["words"].to_numpy()
    for attempt in range(ORDERS):
        rng = np.random.default_rng([attempt, abs(int(blocks["rank"].iloc[0]))])
        order = rng.permutation(len(blocks)) if attempt else np.arange(len(blocks))
        miss, extra = _extra_pass(words[order].tolist(), rest)
        tries.append((miss, attempt, order, extra))
        if miss <= CLOSE * target:
            break
    miss, _, order, extra = min(tries, key=lambda t: t[:2])
    part = np.zeros(len(blocks))
    if miss > CLOSE * target:
        miss, extra = _extra_pass(words[order].tolist(), rest, near=False)
        left = [(w, i) for i, w in enumerate(words[order].tolist()) if w and not extra[i]]
        if left:
            size, at = min(left)  # it didn't fit, so it is larger than what rests
            part[at] = miss / size
    blocks = blocks.iloc[order]
    whole = int(passes) * (blocks["words"].to_numpy() > 0) + np.array(extra)
    times = whole + (part > 0)
    return pd.DataFrame({"nth": blocks["nth"], "block": blocks["block"], "passes": whole, "part": part, "times": times, "begin": np.cumsum(times) - times})


def _draws(docs: DataFrame, seed: int, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized rows, sources (with number, size and target), and block draws (nth, block, passes, part, mix_shards)."""
    sized = stage(sizes(docs, seed), "sizes")
    blocks = stage(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sources = stage(_numbered(blocks.groupBy("source").agg(F.sum("words").alias("source_size"))), "numbered")
    sources = stage(with_targets(sources).withColumnRenamed("source", "mix_source"), "sources")
    ranked = blocks.join(sources, F.col("source").eqNullSafe(F.col("mix_source"))).select(
        "nth", "block", "words", "target", F.xxhash64("block", "nth", F.lit(seed)).alias("rank")
    )
    schema = "nth long, block int, passes int, part double, times int, begin long"
    drawn = stage(ranked.groupBy("nth").applyInPandas(_fill, schema).where("times > 0"), "draws")
    shard = F.expr("transform(sequence(0, times - 1), k -> cast(size(filter(ends, e -> e <= begin + k)) as int))")
    dealt = drawn.join(_shard_ends(drawn, shards, seed), "nth")
    return sized, sources, stage(dealt.select("nth", "block", "passes", "part", shard.alias("mix_shards")), "dealt")


def _with_draws(rows: DataFrame, sources: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows (source, block, ...) with their source's figures and their block's draws, null if not drawn."""
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    return rows.join(drawn, ["nth", "block"], "left")


def plan(docs: DataFrame, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part, shards) for every row.

    copies is how often the mix takes the row whole (0 to 2), part how many words of it once more,
    shards the output shard of each copy, the part's last. A null source is a source of its own,
    the last; a null or empty text has size 0 and is never taken; rows that are equal in every column
    lie in one block and are taken alike, others are told apart even under one doc_id or without one.
    """
    rows = _with_draws(*_draws(docs, seed, shards))
    taken = (F.col("size") > 0) & F.col("passes").isNotNull()
    part = F.when(taken, F.round(F.col("size") * F.col("part"))).otherwise(0)
    copies = F.when(taken, F.col("passes")).otherwise(0)
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        part.cast("long").alias("part"),
        F.when(taken, F.slice("mix_shards", 1, copies + (part > 0).cast("int"))).otherwise(F.array().cast("array<int>")).alias("shards"),
    )


def mix(docs: DataFrame, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """Each row of `docs` as often as `plan` takes it, with mix_shard and mix_order, sorted by both.

    A row taken in part has its first words, joined by spaces. A column of `docs` that is named like
    one of the two new ones is kept as that name with `_input` after it. Partitions hold ranges of
    (mix_shard, mix_order), so that a shard, however large, is read in shuffled order from them.
    """
    _, sources, drawn = _draws(docs, seed, shards)
    name = lambda c: f"{c}_input" if c.lower() in ("mix_shard", "mix_order") else c
    rows = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        F.struct(*[F.col(f"`{c}`").alias(name(c)) for c in docs.columns]).alias("row"),
        row_key(docs).alias("key"),
        F.col("source").cast("string").alias("source"),
        _block(docs, seed).alias("block"),
    )
    if drawn.count() <= BROADCAST_ROWS:
        drawn = F.broadcast(drawn)
    rows = _with_draws(rows, sources, drawn).where("mix_shards is not null")
    copies = rows.select("row", "key", "passes", "part", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(words, 1, F.round(F.size(words) * F.col("part")).cast("int")), " ")
    copies = copies.withColumn("text", F.when(F.col("mix_copy") < F.col("passes"), F.col("row.text")).otherwise(first)).where("text <> ''")
    order = F.xxhash64("key", "mix_copy", F.lit(seed)).alias("mix_order")
    copies = copies.select(F.col("row").withField("text", F.col("text")).alias("row"), "mix_shard", order).select("row.*", "mix_shard", "mix_order")
    return copies.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
