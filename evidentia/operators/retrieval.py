"""Lexical retrieval over notes and exact statute lookup."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.functions import text

#: Queries of one automaton, and notes whose matches make one batch.
QUERY_BLOCK = 10_000
NOTES = 256


def keyed(notes: DataFrame) -> DataFrame:
    """Notes (note_id, title, aliases, body) with their search keys."""
    return notes.select(
        "note_id",
        text.search_key(F.col("note_id").cast("string")).alias("k_id"),
        text.search_key(F.coalesce("title", F.lit(""))).alias("k_title"),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")), text.search_key).alias("k_aliases"),
        text.search_key(F.coalesce("body", F.lit(""))).alias("k_body"),
    )


def search(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """(query_id, note_id, match_rank, position): exact matches of a query if it has any, else substring matches.

    Ranks: 0 id, 1 alias, 2 in title, 3 in an alias, 4 anywhere else; ties go by note id. Blank queries
    match nothing. Queries go to the notes in blocks of at most QUERY_BLOCK, as one automaton that reads
    each note once; the notes aren't shuffled.
    """
    asked = queries.select("query_id", text.search_key(F.col("text")).alias("q")).where("q <> ''")
    types = {"query_id": queries.schema["query_id"].dataType, "note_id": notes.schema["note_id"].dataType}
    block, parts, rows = [], [], keyed(notes)
    for r in asked.toLocalIterator():
        block.append((r.query_id, r.q))
        if len(block) == QUERY_BLOCK:
            parts.append(_matches(block, rows, types))
            block = []
    parts.append(_matches(block, rows, types))
    best = W.partitionBy("query_id")
    found = reduce(DataFrame.unionByName, parts).withColumn("any_exact", F.bool_or("is_exact").over(best)).where("is_exact or not any_exact")
    nth = F.row_number().over(best.orderBy("match_rank", "note_id"))
    return found.select("query_id", "note_id", "match_rank", nth.alias("position"))


def _matches(asked: list[tuple], notes: DataFrame, types: dict) -> DataFrame:
    """(query_id, note_id, is_exact, match_rank): each pair of a query and a note that holds it, from one scan of the notes."""
    shared = notes.sparkSession.sparkContext.broadcast(asked)
    kinds = [to_arrow_type(types["query_id"]), to_arrow_type(types["note_id"]), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, machine = defaultdict(list), ahocorasick.Automaton()
        for query_id, q in shared.value:
            ids[q].append(query_id)
        for q in ids:
            machine.add_word(q, q)
        machine.make_automaton()

        def inside(key: str | None) -> set[str]:
            return {q for _, q in machine.iter(key)} if ids and key else set()

        for batch in batches:
            for lo in range(0, batch.num_rows, NOTES):
                rows = []
                for r in batch.slice(lo, NOTES).to_pylist():
                    names = r["k_aliases"] or []
                    title, aliases = inside(r["k_title"]), set().union(*map(inside, names))
                    for q in title | aliases | inside(r["k_id"]) | inside(r["k_body"]):
                        places = (r["k_id"] == q, q in names, q in title, q in aliases, True)
                        exact = r["k_id"] == q or r["k_title"] == q or q in names
                        rows += [(query_id, r["note_id"], exact, places.index(True)) for query_id in ids[q]]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "note_id", "is_exact", "match_rank"])

    schema = T.StructType([T.StructField("query_id", types["query_id"]), T.StructField("note_id", types["note_id"]), T.StructField("is_exact", T.BooleanType()), T.StructField("match_rank", T.IntegerType())])
    return notes.mapInArrow(run, schema)


def attempts(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, n_matched, matched): every query with its note ids in order, none included."""
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "note_id"))), lambda m: m["note_id"]).alias("matched"))
    rows = queries.select("query_id").join(listed, "query_id", "left")
    return rows.select("query_id", F.coalesce(F.size("matched"), F.lit(0)).alias("n_matched"), "matched")


def first_matches(found: DataFrame) -> DataFrame:
    """Each note once, under the first query that found it."""
    nth = F.row_number().over(W.partitionBy("note_id").orderBy("query_id", "position"))
    return found.withColumn("nth", nth).where("nth = 1").drop("nth")


def statutes(requests: DataFrame, table: DataFrame) -> DataFrame:
    """(law, article, outcome, n_rows, statute_id) for requests (law, article); articles are compared by number.

    Outcomes: FOUND, MISSING, AMBIGUOUS, BLANK_TEXT, BAD_ARTICLE.
    """
    asked = requests.select("law", F.col("article").alias("asked"), text.article_number(F.col("article")).alias("key"))
    rows = table.select(F.col("law").alias("t_law"), text.article_number(F.col("article")).alias("t_key"), "statute_id", "text")
    joined = asked.join(rows, (asked.law == rows.t_law) & (asked.key == rows.t_key), "left").groupBy("law", "asked", "key")
    counted = joined.agg(F.count("statute_id").alias("n_rows"), F.min("statute_id").alias("statute_id"), F.max("text").alias("text"))
    outcome = (
        F.when(F.col("key").isNull(), "BAD_ARTICLE")
        .when(F.col("n_rows") == 0, "MISSING")
        .when(F.col("n_rows") > 1, "AMBIGUOUS")
        .when(text.strip(F.coalesce("text", F.lit(""))) == "", "BLANK_TEXT")
        .otherwise("FOUND")
    )
    return counted.select("law", F.col("asked").alias("article"), outcome.alias("outcome"), "n_rows", F.when(outcome == "FOUND", F.col("statute_id")).alias("statute_id"))
