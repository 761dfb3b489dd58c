"""The pipeline's stages against plain Python versions on a whole small table."""

import brute

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, small):
    docs, columns = small, small.columns
    found = {}
    for name, apply in pipeline.STAGES:
        docs = apply(spark, docs, SF)
        found[name] = docs.collect()
        docs = spark.createDataFrame(found[name], docs.schema)
        if name != "source_mix":
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in small.collect()}

    good = {i for i, t in texts.items() if brute.passes(t)}
    assert {r.doc_id for r in found["quality_rules"]} == good  # no source fails as a whole here

    ids = sorted(good)
    near = brute.near_groups([texts[i] for i in ids], 5)
    single = {r.doc_id for r in found["near_dedup"]}
    # one of each group that is clearly alike stays, and only what has an alike text before it goes
    sure, possible = near(0.9), near(0.65)
    assert all(sum(ids[k] in single for k in group) <= 1 for group in sure)
    assert all(any(ids[k] in single for k in group) for group in possible)
    assert len(found["near_dedup"]) == len(single)

    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {i for i in single if any(t in " ".join(texts[i].lower().split()) for t in items)}
    clean = {r.doc_id for r in found["decontamination"]}
    assert clean <= single - exact and len(single - exact - clean) <= 2

    secret = {r.doc_id: r for r in found["secret_scan"]}
    assert set(secret) == clean
    for i, r in secret.items():
        counts, _, _ = brute.spans(texts[i], brute.SECRET_KINDS)
        assert r.n_chars == len(r.text)
        assert r.text == texts[i] if not counts else sum(brute.spans(r.text, brute.SECRET_KINDS)[0].values()) == 0

    mixed = [r.doc_id for r in found["source_mix"]]
    assert set(mixed) <= clean and max(map(mixed.count, set(mixed))) <= 2
    size = {i: len(brute.words(r.text)) for i, r in secret.items()}
    assert abs(sum(size[i] for i in mixed) / sum(size.values()) - 1.5) < 0.05


def test_run_gives_the_last_stage(spark):
    rows = pipeline.run(spark, SF)
    assert {"doc_id", "text", "mix_shard", "mix_order"} <= set(rows.columns) and rows.count() > 100


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    """The whole chain on nulls, blanks, repeats and clashing names; texts under one id stay apart."""
    from pyspark.sql import functions as F

    prose = [" ".join(f"{a}{k}" for k in range(70)) for a in "abc"]
    more = spark.createDataFrame([(2, t, "en", s, None, None, None) for t, s in zip([*prose, prose[0]], ["a", None, "a", "a"], strict=True)], odd_docs.schema)
    docs = odd_docs.union(more).withColumn("mix_shard", F.lit("own")).withColumn("row", F.lit(1))
    columns = docs.columns
    for name, apply in pipeline.STAGES:
        empty = apply(spark, no_docs, SF)
        assert empty.collect() == []
        docs = spark.createDataFrame(apply(spark, docs, SF).collect(), apply(spark, docs, SF).schema)
        if name != "source_mix":
            assert docs.columns == columns
        if name == "near_dedup":
            assert sorted(r.text for r in docs.where("doc_id = 2").collect()) == sorted(prose)
    assert {"mix_shard_input", "mix_shard", "mix_order"} <= set(docs.columns) and docs.count() > 0
    assert {t for t in prose if docs.where(F.col("text") == t).count()} <= set(prose)
