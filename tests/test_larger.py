"""Queries and operators on odd rows and past the sizes of the driver's small tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from evidentia.plans import catalogue


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as lists of dicts."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows), folder / f"{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    wanted = con.sql(catalogue.ORACLE_SQL[name])
    found = catalogue.QUERIES[name](spark, str(folder)).select(*wanted.columns)
    return sorted(map(tuple, found.collect()), key=repr), sorted(map(tuple, wanted.fetchall()), key=repr)


def test_handoff_is_one_text_however_long(spark, tmp_path):
    """A source of more characters than a part holds has one row, the hash of the whole."""
    rows = [{"doc_id": i, "text": f"page {i} é \n" + "lorem ipsum " * 90_000 + " \n", "lang": "en", "source": "a" if i % 4 else "b"} for i in range(44)]
    found, wanted = both(spark, tmp_path, "handoff_markdown", documents=rows)
    assert found == wanted and len(found) == 2


def test_handoff_hash_is_that_of_the_joined_parts(spark):
    import hashlib

    from pyspark.sql import functions as F

    from evidentia.operators import review

    rows = spark.createDataFrame([(d, n, f"text {d}{n} " * 20) for d in ("x", "y") for n in range(12)], "document string, page_number int, canonical_text string")
    supplements = "array<struct<record_id:string,kind:string,ocr_text:string,ocr_confidence:double,review_status:string>>"
    marks, task = "array<struct<id:string,color:string,review_status:string>>", "struct<review_categories:array<string>>"
    rows = rows.withColumns({c: F.lit(c) for c in ("trust", "origin", "canonical_source")} | {c: F.lit(None).cast(t) for c, t in (("supplements", supplements), ("markers", marks), ("task", task))})
    parts = review.handoff(rows, most=700).orderBy("document", "part").collect()
    whole = {d: hashlib.sha256("".join(r.markdown for r in parts if r.document == d).encode()).hexdigest() for d in "xy"}
    assert len(parts) > 6 and {r.document: r.markdown_sha256 for r in review.handoff_hash(rows).collect()} == whole


def test_blank_texts_are_no_files(spark, tmp_path):
    """Empty and blank texts are left out, other whitespace is text; the planted ones stay."""
    bodies = ["", " \n ", "\t", "　", None, "x", "\n\n"]
    rows = [{"doc_id": 7 * k + r, "text": t} for k, t in enumerate(bodies) for r in range(7)]
    found, wanted = both(spark, tmp_path, "text_files", documents=rows)
    assert found == wanted


def test_ordinals_of_equal_places_do_not_depend_on_row_order(spark):
    from evidentia.operators import routing

    rows = [("d", p, "k", 2_000_005, n, part) for p in range(40) for n, part in ((2, 5), (1, 1_000_005))]
    shape = "document string, page_number int, kind string, source_index long, line int, part long"
    found = routing.ordinals(spark.createDataFrame(rows, shape), "line", "part").collect()
    assert {(r.line, r.target_id[-3:]) for r in found} == {(1, "001"), (2, "002")}


def test_exploded_sides_are_not_broadcast(spark, tmp_path):
    """Marks, words and characters of many pages stay with the executors, whatever their source's size."""
    pq.write_table(pa.table({"c_custkey": pa.array(range(500), pa.int64())}), tmp_path / "customer.parquet")
    for name in ("logical_markers", "red_clusters"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
        assert "Scan" in plan and "Broadcast" not in plan


def test_red_clusters_across_batches(spark, monkeypatch):
    """Pages that straddle Arrow batches keep all their marks, and pages pass without a group each."""
    from evidentia.operators import markers

    rows = [(str(d), 1, i, [40.0 * (i // 2) + 5 * (i % 2), 0.0, 40.0 * (i // 2) + 10, 5.0], "red_vector_evidence") for d in range(50) for i in range(7)]
    marks = spark.createDataFrame(rows, "document string, page_number int, drawing_index int, rect array<double>, kind string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        clusters = markers.red_clusters(marks)
        found = clusters.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = {(str(d), 1, k + 1, 40.0 * k, 40.0 * k + 10) for d in range(50) for k in range(4)}
    assert {(r.document, r.page_number, r.cluster, r.bbox[0], r.bbox[2]) for r in found} == wanted and len(found) == 200
    assert "FlatMapGroups" not in clusters._jdf.queryExecution().optimizedPlan().toString()


def test_only_texts_that_nfkc_may_change_go_through_python(spark):
    import random
    import unicodedata

    from pyspark.sql import functions as F

    from evidentia.functions import text

    rnd = random.Random(5)
    odd = ["é", "é", "́", "ﬁ", "Ａ", "ᄀ", "ᅡ", "ᆨ", "가", "각", "か", "゙", "。", "①", " ", "…", "x", " ", "ß", "漢", "ে", "া", "😀", "\U0001d400", "塚"]
    bodies = ["".join(rnd.choices(odd, k=rnd.randint(0, 6))) for _ in range(3000)] + [chr(c) for c in range(0x3000) if c] + [None]
    rows = spark.createDataFrame([(b,) for b in bodies], "t string").select("t", text.nfkc(F.col("t")).alias("n"))
    assert all(r.n == (r.t if r.t is None else unicodedata.normalize("NFKC", r.t)) for r in rows.collect())
    stable = F.col("t").rlike(f"[^{text.stable_class()}]")
    assert not any(r[0] for r in spark.createDataFrame([("plain",), ("né à Köln, Öl",), ("漢字と",), ("한글",)], "t string").select(stable).collect())


def test_archives_are_unpacked_a_few_members_at_a_time(spark, monkeypatch):
    """Members of many archives in one batch go out as they are read, with and without their content."""
    from evidentia.sources import files, sinks

    members = spark.createDataFrame([(f"p{p}", f"m{i:02}", f"{p}{i}" * 50) for p in range(6) for i in range(20)] + [("p0", "m00", "again")], "packet string, member string, content string")
    built = [(r.packet, bytes(r.content)) for r in sinks.packets(members).collect()] + [("broken", b"no zip")]
    archives = spark.createDataFrame(built, "path string, content binary").coalesce(1)
    monkeypatch.setattr(files, "BATCH_BYTES", 500)
    whole, bare = files.zip_members(archives).collect(), files.zip_members(archives, content=False).collect()
    assert sorted((r.path, r.member, r.content.decode()) for r in whole if r.member) == sorted(map(tuple, members.collect()))
    assert sorted(map(repr, (tuple(r)[:5] for r in whole))) == sorted(map(repr, map(tuple, bare))) and len(bare) == 122


def test_boxes_are_dealt_out_before_they_are_compared(spark, tmp_path):
    """No task aggregates a whole input file, and a page's images in several rows count once each."""
    rows = [{"l_orderkey": i % 7, "l_quantity": float(i % 5 + 1), "l_linenumber": i % 3 + 1} for i in range(200)]
    found, wanted = both(spark, tmp_path, "page_image_coverage", lineitem=rows)
    assert found == wanted
    plan = catalogue.QUERIES["page_image_coverage"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Exchange")[-1] and "collect_list" not in plan
