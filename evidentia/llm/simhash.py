"""Near-duplicate documents by SimHash and bit-sliced comparison.

Fingerprints within `radius` differing bits are linked, links close to components. Equal texts or
fingerprints collapse to one node first. Nodes meet in buckets; in a bucket the bits of all members
are stored vertically, one plane a bit, and one member is compared with all others at once by
carry-save counters. Buckets of 64-bit fingerprints within 2 bits are pairs of blocks of bits, which
miss no pair. `keep_one` asks for texts that are alike by a given share of their shingles, which
differ in too many bits for blocks: there fingerprints are wider, and buckets are made of the
smallest digests of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.text import as_bytes, bounded, mixed, row_key, text_key
from evidentia.operators.graphs import roots
from evidentia.staging import stage

SEED = 42
SHINGLE = 3
#: Members of a bucket that are compared in one piece.
GROUP = 4_096
#: Shingles and similarity of `keep_one`, bits of its fingerprints, and buckets a text lies in, of so many digests each.
STAGE_SHINGLE = 5
STAGE_SIMILARITY = 0.8
WIDE = 256
BANDS, ROWS = 10, 4
#: Members of a large bucket that each part of it is compared with.
LEADERS = 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(starts), 65025):
        part = zip(starts[lo : lo + 65025], ends[lo : lo + 65025], strict=True)
        found = np.array([digest(joined[a:b], SEED) for a, b in part], np.uint64)
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    majority = counts * 2 > len(starts)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 8 << 20):
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def near(members: list[int], radius: int, width: int = 64, known: Callable[[int], int] = lambda i: 0) -> Iterator[tuple[int, int]]:
    """Index pairs (i < j) of `members`, numbers of `width` bits, within `radius` bits.

    Lane j of a plane is that bit of member j. Counters of all lanes are stored vertically too and
    begin so that one more than `radius` differing bits carries out of the highest: that lane is
    gone. A member is given up as soon as all its lanes are gone. Planes on which all members agree
    can't add to a distance. `known(i)` has the lanes that member i needn't be compared with.
    """
    size = len(members)
    full = (1 << size) - 1
    raw = b"".join(m.to_bytes(width // 8, "little") for m in members)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(size, -1), axis=1, bitorder="little")
    columns = np.packbits(bits.T, axis=1, bitorder="little")
    planes = [int.from_bytes(c.tobytes(), "little") for c in columns]
    varying = [(p, x) for p, x in enumerate(planes) if x and x != full]
    digits = (radius + 1).bit_length()
    first = [full * ((1 << digits) - 1 - radius >> k & 1) for k in range(digits)]
    for i, member in enumerate(members[:-1]):
        gone = (1 << (i + 1)) - 1 | known(i)
        counters = first.copy()
        for p, plane in varying:
            if gone == full:
                break
            carry = plane ^ full if member >> p & 1 else plane
            for k in range(digits):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
                if not carry:
                    break
            gone |= carry
        left = full & ~gone
        while left:
            j = left.bit_length() - 1
            left ^= 1 << j
            yield i, j


def _forest(members: list[int], radius: int, width: int) -> Iterator[tuple[int, int]]:
    """Links (i, j), from members to the first of their group, of the groups that `near` pairs make."""
    up, lanes = list(range(len(members))), [1 << i for i in range(len(members))]

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in near(members, radius, width, lambda i: lanes[top(i)]):  # what one group holds isn't compared again
        a, b = sorted((top(i), top(j)))
        if a != b:
            up[b] = a
            lanes[a] |= lanes[b]
    for i in range(len(members)):
        if (a := top(i)) != i:
            yield i, a


def _compared(rows: DataFrame, radius: int, width: int) -> DataFrame:
    """Links (u, v) of nodes whose fingerprints are near, from rows (bucket, node, sign); a bucket is compared as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, nodes, signs = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                found = np.array(list(_forest(signs, radius, width)), np.int64).reshape(-1, 2)
                names = np.array(nodes, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[found[:, 0]]), pa.array(names[found[:, 1]])], ["u", "v"])

        for batch in batches:
            for key, node, sign in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", "sign")), strict=True):
                if key != bucket:
                    yield from out()
                    bucket, nodes, signs = key, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    signs.append(int.from_bytes(sign, "little"))
        yield from out()

    rows = rows.select("bucket", "node", "sign").repartition("bucket").sortWithinPartitions("bucket", "node")
    return rows.mapInArrow(run, "u long, v long")


def _pair_masks(bits: list[int], blocks: int) -> list[tuple[int, list[int]]]:
    """For each pair of `blocks` blocks of the bit places `bits`: a mask of the pair's bits, and the places it leaves."""
    edges = [len(bits) * k // blocks for k in range(blocks + 1)]
    parts = [bits[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    chosen = [(set(a) | set(b)) for a, b in combinations(parts, 2)]
    return [(sum(1 << p for p in c), [p for p in bits if p not in c]) for c in chosen]


def links(nodes: DataFrame, radius: int = 2, group: int = GROUP) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` that join all pairs within `radius`.

    Nodes meet under each pair of blocks of bits. A bucket of over `group` members is split by
    pairs of blocks of the bits left, and again: two members within `radius` meet at each level,
    and after three there are too few bits left for a bucket to be large. A member has 6, then 36,
    then 216 rows at most, however large its bucket is.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    paths = [(0, list(range(64)))]
    rows = nodes.select(F.col("fp").alias("node"), F.lit(0).alias("path"))
    ready = []
    for level in range(3):
        below = [[(mask | m, rest) for m, rest in _pair_masks(free, radius + 2)] for mask, free in paths]
        masks = F.array(*[F.array(*[F.lit(signed(m)) for m, _ in part]) for part in below])
        width = len(below[0])
        keyed = rows.select("node", F.posexplode(F.get(masks, F.col("path"))).alias("nth", "mask"), "path")
        keyed = keyed.select("node", (F.col("path") * width + F.col("nth")).alias("path"), F.col("node").bitwiseAND(F.col("mask")).alias("bits"))
        counts = stage(keyed.groupBy("path", "bits").count().where("count > 1"), "buckets")
        keyed = keyed.join(counts, ["path", "bits"])
        paths = [p for part in below for p in part]
        last = level == 2 or len(paths[0][1]) < radius + 2 or not counts.where(F.col("count") > group).take(1)
        fits = F.lit(True) if last else F.col("count") <= group
        ready.append(keyed.where(fits).select(F.xxhash64(F.lit(level), "path", "bits").alias("bucket"), "node"))
        if last:
            break
        rows = stage(keyed.where(~fits).select("node", "path"), "hot_nodes")
    rows = reduce(DataFrame.union, ready)
    return _compared(rows.withColumn("sign", F.unhex(F.lpad(F.hex("node"), 16, "0"))), radius, 64)


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. A null or
    empty text has fingerprint 0 and is linked like any other; a null doc_id takes no part
    in the minimum, and is null if its whole component has none; repeated rows each get a row.
    """
    found = stage(fingerprints(docs), "fingerprints")
    nodes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    linked = stage(roots(links(nodes, radius)), "roots")
    least = linked.join(nodes, linked.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component"))
    near_groups = linked.join(stage(least, "least"), "root").select(F.col("node").alias("fp"), "component")
    copies = nodes.where("n > 1").select("fp", "least")
    groups = copies.join(near_groups, "fp", "full").select("fp", F.coalesce("component", "least").alias("component"))
    # a group's own smallest doc_id is exact; rows outside any group stand alone
    groups = stage(groups, "groups").withColumn("grouped", F.lit(True))
    own = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id"))
    return found.join(groups, "fp", "left").select("doc_id", "fp", own.alias("component_id"))


def hex_digits(fp: str = "fp"):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def radius_for(similarity: float) -> int:
    """Differing bits of WIDE that shingle sets of this Jaccard similarity seldom pass: the mean and one standard deviation."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return round(WIDE * share + sqrt(WIDE * share * (1 - share)))


_LANES = mixed(np.arange(1, WIDE // 64 + 1, dtype=np.uint64))
_ODD = mixed(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


class _Digests(dict):
    """64-bit digest of each word, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def sketch(text: bytes | None, shingle: int, digests: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """A WIDE-bit fingerprint of a text's set of shingles, and the keys of the buckets it lies in.

    A bucket's key is made of ROWS smallest shingle digests, each by another order of all digests.
    """
    words = (text or b"").lower().split()
    own = np.fromiter(map(digests.__getitem__, words), np.uint64, len(words))
    width = max(1, min(shingle, len(own)))
    whole = np.zeros(max(len(own) - width + 1, 0), np.uint64)
    for k in range(width):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(whole)]
    shingles = np.unique(mixed(whole)) if len(whole) else np.zeros(1, np.uint64)
    counts, least = np.zeros(WIDE, np.int64), np.full(len(_ODD), np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 4080):
        part = shingles[lo : lo + 4080, None]
        bits = np.unpackbits(mixed(part + _LANES).view(np.uint8), axis=1, bitorder="little")
        rows = len(bits) // 255 * 255
        counts += bits[:rows].reshape(-1, 255, WIDE).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[rows:].sum(axis=0, dtype=np.uint8)
        least = np.minimum(least, (part * _ODD).min(axis=0))
    sign = np.packbits(counts * 2 > len(shingles), bitorder="little").tobytes()
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return sign, keys.view(np.int64)


def sketches(docs: DataFrame, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """(doc_id, node, row, sign, meets) for every row: node and row are digests of the text and of the whole row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _Digests()
        for batch in bounded(batches, "text", 8 << 20):
            found = [sketch(t, shingle, digests) for t in as_bytes(batch.column("text"))]
            sign = pa.array([s for s, _ in found], pa.binary())
            meets = pa.array([k for _, k in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sign, meets], [*names, "sign", "meets"])

    names = ["doc_id", "node", "row"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("node"), row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, node long, row long, sign binary, meets array<long>")


def wide_links(nodes: DataFrame, radius: int, group: int = GROUP) -> DataFrame:
    """Links (u, v) that join all pairs of `nodes` (node, sign, meets) that share a bucket and lie within `radius`.

    A bucket of over `group` members is dealt into parts, each beside the same few leaders. If that
    leaves a bucket in several components, all members outside the largest are compared with the
    whole bucket, part by part: no pair is missed, and a bucket of copies isn't compared pair by pair.
    """
    rows = nodes.select("node", "sign", F.explode("meets").alias("key"))
    counts = stage(rows.groupBy("key").count().where("count > 1"), "buckets")
    rows = stage(rows.join(counts, "key").withColumn("parts", F.ceil(F.col("count") / group).cast("int")), "met")
    dealt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    first = rows.select(F.xxhash64("key", dealt(F.col("parts"), 7)).alias("bucket"), "node", "sign")
    hot = rows.where("parts > 1")
    if not counts.where(F.col("count") > group).take(1):
        return _compared(first, radius, WIDE)
    leaders = hot.groupBy("key", "parts", dealt(F.lit(LEADERS), 11).alias("class")).agg(F.min(F.struct("node", "sign")).alias("leader"))
    leaders = leaders.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "leader.*")
    first = first.union(leaders.select(F.xxhash64("key", "part").alias("bucket"), "node", "sign"))
    found = stage(_compared(first, radius, WIDE), "links")
    hot = hot.join(stage(roots(found), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    hot = stage(hot.select("key", "node", "sign", "parts", "root"), "hot")
    sizes = hot.groupBy("key", "root").count().groupBy("key")
    sizes = sizes.agg(F.max_by("root", F.struct("count", "root")).alias("most"), (F.sum("count") - F.max("count")).alias("apart"))
    hot = hot.join(stage(sizes.where("apart > 0"), "apart"), "key").withColumn("sets", F.ceil(F.col("apart") / group).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    whole = hot.select("key", "node", "sign", F.explode(every("sets")).alias("set"), dealt(F.col("parts"), 7).alias("part"))
    others = hot.where("root <> most").select("key", "node", "sign", F.explode(every("parts")).alias("part"), dealt(F.col("sets"), 13).alias("set"))
    second = whole.unionByName(others).select(F.xxhash64("key", "set", "part", F.lit(1)).alias("bucket"), "node", "sign")
    return found.union(_compared(second, radius, WIDE))


def keep_one(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """One row of `docs` for each group of near duplicates, in the same columns.

    Texts are near whose sets of `shingle`-word shingles are about `similarity` alike or more, as
    told by fingerprints of WIDE bits; texts that differ are told apart even under one doc_id. The
    row with the smallest doc_id stays, of equal ones the smallest by digest of the row; rows
    without a doc_id come last. Null texts and texts without words are alike. Rows that are equal
    in every column are one row.
    """
    rows = stage(sketches(docs, shingle), "sketches")
    same = rows.groupBy("node", "row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("sign").alias("sign"), F.first("meets").alias("meets"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "n")
    nodes = stage(same.groupBy("node").agg(F.min(order).alias("best"), F.first("sign").alias("sign"), F.first("meets").alias("meets")), "nodes")
    linked = stage(roots(wide_links(nodes.select("node", "sign", "meets"), radius_for(similarity))), "roots")
    known = linked.join(nodes.select("node", "best"), "node")
    best = stage(known.groupBy("root").agg(F.min(F.struct("best", "node")).alias("first")).select("root", F.col("first.node").alias("kept")), "best")
    gone = stage(linked.join(best, "root").where("node <> kept").select("node"), "gone")
    kept = nodes.join(gone, "node", "left_anti").select("node", F.col("best.row").alias("kept_row"), F.col("best.n").alias("n"))
    kept = stage(kept, "kept")
    held = docs.select(F.struct("*").alias("row"), text_key().alias("own"), row_key(docs).alias("own_row"))
    found = held.join(kept, (F.col("own") == F.col("node")) & (F.col("own_row") == F.col("kept_row")))
    once = found.where("n = 1").select("row.*")
    if not kept.where("n > 1").take(1):
        return once
    return once.union(found.where("n > 1").dropDuplicates(["own", "own_row"]).select("row.*"))
