"""Queries with SQL against DuckDB: whole small tables, and planted cases that make the methods speak."""

import random

import duckdb
import pytest

from evidentia.llm import catalogue, personal, quality, secrets

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order] for r in found), key=repr)


def agrees(found, sql, documents):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{documents}'")
    expected = con.sql(sql)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_small_tables(spark, name):
    agrees(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], f"{SF}/documents.parquet")


def planted(spark, tmp_path, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    data = [(i, t, "en", s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d")), f"{tmp_path}/d/*.parquet"


def test_revealing_terms(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(300)]
    prose = lambda n=60: " ".join(rng.choices(vocabulary, k=n))
    known = [f"{prose()} by mercury{i % 3} Écho to user{i}@mail.example.com Zenith, zenith or +1 (212) 555-{1000 + i} {prose()}" for i in range(40)]
    known += [f"{prose()} Marlowe reads jane@corp.example.com {prose()}" for _ in range(12)]
    copied = [f"{prose()} Quillon reads joan@corp.example.com and {prose()}"] * 9
    copied = [f"{t} {prose(2)}" for t in copied]  # near copies are one witness
    docs, path = planted(spark, tmp_path, known + copied + [prose(120) for _ in range(200)] + ["zenith alone", None])
    found = {r.doc_id: r.spans for r in personal.scan(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = lambda i: {texts[i][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in found[i].split(",") if s) if k.startswith("term")}
    assert all({"écho", "zenith"} <= gone(i) for i in range(40)) and all("marlowe" in gone(i) for i in range(40, 52))
    assert not any("quillon" in gone(i) for i in range(52, 61)) and not any(gone(i) for i in range(61, 263))
    named = {"mercury", "zenith", "écho", "marlowe", "reads"}
    right = [gone(i) & named for i in range(52)], [gone(i) - named for i in range(52)]
    assert sum(map(len, right[1])) <= 0.05 * sum(map(len, right[0]))
    agrees(personal.scan(docs), catalogue.ORACLE_SQL["op6_personal_data"], path)


def test_linked_parts(spark, tmp_path):
    texts = ["username: alice Zx81kQw0PqLm55TrYv99 https://db.example.com/x", "login=bob_b password=hunter22 and " + "w " * 300 + "user=carol", "é" * 199 + " user=abc " + "é" * 190 + " token=abcdef1", "x@y.zz " + "w " * 150 + "\n \t\n" + "w " * 40 + "secret: abcdef https://a.b/c", "u@v.ww " + "w " * 600 + "token=abcdef1\n\n" + "f" * 30, None]
    docs, path = planted(spark, tmp_path, texts)
    found = secrets.secret_scan(docs)
    assert found.where("spans like '%linked%'").count() >= 2
    agrees(found, catalogue.ORACLE_SQL["op7_secret_scan"], path)


def test_rejected_host(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80))
    hosts = ["bad"] * 32 + [f"good{i % 6}" for i in range(60)] + [None, "bad"]
    docs, path = planted(spark, tmp_path, ["tiny"] * 30 + [good] * 58 + ["tiny"] * 4 + [None, good + " ### $$$ %%% &&& ***" * 20], hosts)
    columns = catalogue.QUERIES["op8_quality_rules"](spark, SF).columns
    from pyspark.sql import functions as F

    found = quality.judge(docs).withColumn("host_rate", F.round("host_rate", 6)).select(columns)
    assert found.where("kept").count() == 56
    agrees(found, catalogue.ORACLE_SQL["op8_quality_rules"], path)
