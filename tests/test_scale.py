"""Operators whose plans must hold at scale, against plain versions."""

import difflib
import random

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import alignment, graphs, markers, reconciliation, retrieval

RANDOM = random.Random(3)


def test_approximate_pairs_are_those_of_all_pairs(spark):
    """Length bands and character counts lose no pair of pages that the ratio itself would pair."""
    prose = lambda n: " ".join("".join(RANDOM.choices("abcdefghij", k=RANDOM.randint(2, 8))) for _ in range(n))
    old = [prose(RANDOM.randint(8, 60)) for _ in range(60)]
    new = []
    for t in old:
        k = RANDOM.randrange(len(t))
        new.append(t[:k] + RANDOM.choice(["", "x", "xy z", "ab" * 4]) + t[k + RANDOM.randint(0, 3) :])
    shape = lambda texts: spark.createDataFrame(
        [("d", i, "img", 100.0, 100.0, t, "v", "a") for i, t in enumerate(texts)],
        "document string, page_number int, image_fingerprint string, width double, height double, normalized_text string, vector_fingerprint string, annotation_fingerprint string",
    )
    found = {(r.previous_page, r.current_page) for r in alignment.candidates(shape(old), shape(new)).collect()}
    every = {
        (i, j)
        for i, a in enumerate(old)
        for j, b in enumerate(new)
        if min(len(a), len(b)) >= alignment.MIN_LENGTH and difflib.SequenceMatcher(None, a, b).ratio() >= alignment.MIN_SIMILARITY
    }
    assert found == every and 10 < len(every)


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graphs, "_small_star", lambda edges, step=graphs._small_star: rounds.append(1) or step(edges))
    nodes = spark.createDataFrame([("d", f"{i:04}") for i in range(300)] + [("e", "0000")], "document string, id string")
    pairs = spark.createDataFrame([("d", f"{i:04}", f"{i + 1:04}") for i in range(200)], "document string, a string, b string")
    found = {(r.document, r.id): r.component for r in markers.components(nodes, pairs).collect()}
    assert len(found) == 301 and all(found["d", f"{i:04}"] == "0000" for i in range(201)) and found["d", "0250"] == "0250"
    assert len(rounds) <= 14


def test_search_is_that_of_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    words = ["alpha", "beta", "gamma", "al", "ph a", "Alpha Beta"]
    notes = [(i, RANDOM.choice(["alpha", "beta note", None]), RANDOM.choice([None, ["gamma", "al"], []]), " ".join(RANDOM.choices(words, k=3))) for i in range(40)]
    queries = [(str(k), w) for k, w in enumerate([*words, "17", "", "none", "beta note", "alpha"])]
    found = retrieval.search(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(notes, "note_id int, title string, aliases array<string>, body string"))
    key = lambda t: "".join((t or "").casefold().split())
    plain = {}
    for query_id, q in queries:
        if not (q := key(q)):
            continue
        rows = []
        for i, title, aliases, body in notes:
            names = [key(a) for a in aliases or []]
            rank = next((k for k, x in enumerate([key(str(i)) == q, q in names, q in key(title), any(q in a for a in names), q in key(body) or q in key(str(i))]) if x), None)
            if rank is not None:
                rows.append((key(str(i)) == q or key(title) == q or q in names, rank, i))
        rows = [r for r in rows if r[0]] or rows
        plain |= {(query_id, i): (rank, n) for n, (_, rank, i) in enumerate(sorted(rows, key=lambda r: r[1:]), 1)}
    assert {(r.query_id, r.note_id): (r.match_rank, r.position) for r in found.collect()} == plain


def test_packets_in_parts(spark):
    from evidentia.sources import files, sinks

    members = spark.createDataFrame([(p, f"m{i:02}", f"{p}{i}" * (i + 1)) for p in "ab" for i in range(20)] + [("a", "z", "q" * 500)], "packet string, member string, content string")
    whole, parts = sinks.packets(members).collect(), sinks.packets(members, most=100).collect()
    assert [(r.packet, r.part) for r in sorted(whole)] == [("a", 0), ("b", 0)] and len(parts) > 6
    for built in (whole, parts):
        read = files.zip_members(spark.createDataFrame([(f"{r.packet}", bytes(r.content)) for r in built], "path string, content binary"))
        assert {(r.path, r.member, r.content.decode()) for r in read.collect()} == {tuple(r) for r in members.collect()}


def test_rendered_documents_in_parts(spark):
    from pyspark.sql import functions as F

    from evidentia.operators import review

    rows = spark.createDataFrame([(d, n, f"text {d}{n} " * 20) for d in ("x", "y") for n in range(12)], "document string, page_number int, reconciled_text string")
    rows = rows.withColumns({"native_text": F.lit("own"), "task": F.lit(None).cast("struct<issues:array<struct<category:string,id:string,reason:string>>>")})
    whole = {r.document: r.markdown for r in review.audit(rows).collect()}
    parts = review.audit(rows, most=700).orderBy("document", "part").collect()
    assert len(parts) > 6 and max(len(r.markdown) for r in parts) < 1_500
    assert {d: "".join(r.markdown for r in parts if r.document == d) for d in whole} == whole


def _edited(alphabet, size):
    """Two texts: anything, a part, a longer or upper-case form, or some edits of the other."""
    a = "".join(RANDOM.choices(alphabet, k=size))
    b = list(a)
    for _ in range(RANDOM.randint(1, 9)):
        k = RANDOM.randrange(len(b) + 1)
        b[k : k + RANDOM.randint(0, 3)] = RANDOM.choices(alphabet, k=RANDOM.randint(0, 4))
    other = RANDOM.choice(["".join(b), "".join(b), a[3 : size // 2], "Note:" + a + "x", a.upper(), "".join(RANDOM.choices(alphabet, k=size))])
    return RANDOM.choice([(a, other), (other, a)])


def test_ratio_is_difflib_on_all_kinds_of_texts():
    for alphabet in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyzABC0123456789.,", "漢字かな交じり文abc"):
        for size in (1, 20, 199, 200, 201, 450):
            for _ in range(12):
                a, b = _edited(alphabet, size)
                assert text._ratio(a, b) == (1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio())


def test_trimming_lines_normalises_no_page_over_again(monkeypatch):
    """All lines of a page together normalise a few times the page, not the page for each line."""
    lines = [f"line {n} " + "".join(RANDOM.choices("abcdefé漢が", k=40)) for n in range(200)]
    page, read = "\n".join(lines), []
    monkeypatch.setattr(text, "_tight", lambda t, f=text._tight: read.append(len(t)) or f(t))
    assert [text._trim(n, n, page) for n in lines] == lines
    assert sum(read) < 12 * len(page)


def test_decisions_send_a_page_once(spark):
    lines = [f"Χ{n} word" for n in range(40)]
    pages = spark.createDataFrame([("d", 1, "\n".join(lines), "medium"), ("d", 2, None, "low")], "document string, page_number int, native_text string, trust string")
    rows = [("d", p, f"{n:02}", "suspect_native_text", t, f"A{n}word", True, 0.9) for p in (1, 2) for n, t in enumerate(lines)] + [("d", 1, "x", "full_page", None, "A1 word A2 wo", None, 0.9), ("d", 1, "y", "suspect_native_text", None, "z", None, None)]
    records = spark.createDataFrame(rows, "document string, page_number int, record_id string, kind string, native_candidate string, ocr_text string, coordinate_match boolean, ocr_confidence double")
    decided = reconciliation.decisions(records, pages)
    found = {(r.page_number, r.record_id): r for r in decided.collect()}
    assert len(found) == 81 and found[1, "y"].candidate is None and found[1, "y"].status == "REVIEW_REQUIRED"
    for p, n in ((1, 1), (1, 2), (2, 5)):
        row = found[p, f"{n:02}"]
        assert (row.candidate, row.support) == (f"A{n}word", {(1, 1): True, (1, 2): False}.get((p, n)))
        assert row.similarity == round(difflib.SequenceMatcher(None, f"Χ{n}word", f"A{n}word").ratio(), 6)
    plan = decided._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("page_repairs") and plan.count("ArrowEvalPython") == 2  # nearer to the result comes first


def test_protected_wording_is_found_behind_ascii(spark):
    rows = spark.createDataFrame([("plain text, no digit",), ("abc 第 3条",), ("x年",), ("条件",), ("a５b",), ("７項",), ("item 4",), ("",)], "t string")
    found = [r[0] for r in rows.select(text.is_protected(F.col("t"), F.col("t"))).collect()]
    assert found == [False, True, True, False, True, True, True, False]


def test_alignment_makes_its_pairs_once(spark):
    prose = lambda n: " ".join("".join(RANDOM.choices("abcdefghij", k=5)) for _ in range(n))
    texts = [prose(30) for _ in range(6)]
    shape = lambda rows: spark.createDataFrame(
        [("d", i, t, "img", 100.0, 100.0, t, "v", "a") for i, t in enumerate(rows)],
        "document string, page_number int, stable_page_id string, image_fingerprint string, width double, height double, normalized_text string, vector_fingerprint string, annotation_fingerprint string",
    )
    found = alignment.align(shape(texts), shape([texts[1], *(t + "!" for t in texts[2:]), "short"]))
    pairs = {(r.previous_page, r.current_page, r.classification) for r in found.collect()}
    assert pairs == {(0, None, "DELETED"), (1, 0, "MOVED"), *((i, i - 1, "MOVED_CONTENT_CHANGED") for i in range(2, 6)), (None, 5, "NEW")}
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ratio_below_the_least_is_null():
    for _ in range(60):
        a, b = _edited("abcdefghijklmnop ", RANDOM.choice([30, 150, 400]))
        ratio = text._ratio(a, b)
        for least in (0.3, 0.985, ratio):
            assert text._ratio(a, b, least) == (ratio if ratio >= least else None)


def test_collapse_is_that_of_all_whitespace(spark):
    texts = ["".join(RANDOM.choices("ab  \n\t\x1c\u00a0\u3000é漢", k=RANDOM.randint(0, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(text.collapse(F.col("t"))).collect()] == [" ".join(t.split()) for t in texts]
