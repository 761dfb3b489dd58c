"""Reconciliation, repair, review, validation, rendering and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import markers, pages, reconciliation, retrieval, review, sets
from evidentia.plans.registry import query
from evidentia.session import load
from evidentia.sources import files, sinks

_LINES = """
    with l as (select doc_id, i, x from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(x) <> ''),
    e as (select doc_id, i, trim(regexp_replace(x, '\\s+', ' ', 'g')) as native,
      trim(regexp_replace(case (doc_id + i) % 5 when 0 then x when 1 then concat('Note: ', x) when 2 then replace(x, ' ', '') when 3 then upper(x) else left(x, length(x) // 2) end, '\\s+', ' ', 'g')) as seen from l),
    a as (select *, replace(native, ' ', '') as tn, replace(seen, ' ', '') as ts from e),
    r as (select *, case when seen = '' then null when native = seen then 'exact'
      when length(native) >= 2 and contains(seen, native) then 'native_contained_in_ocr'
      when length(seen) >= 2 and contains(native, seen) then 'ocr_contained_in_native'
      when tn = ts then 'exact_ignoring_whitespace'
      when length(tn) >= 2 and contains(ts, tn) then 'native_contained_in_ocr_ignoring_whitespace'
      when length(ts) >= 2 and contains(tn, ts) then 'ocr_contained_in_native_ignoring_whitespace' end as agreement from a)
"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that isn't blank as a native span, with a recognised text that differs in a known way."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).where("trim(x) <> ''")
    way, x = (F.col("doc_id") + F.col("i") + 1) % 5, F.col("x")
    seen = (
        F.when(way == 0, x)
        .when(way == 1, F.concat(F.lit("Note: "), x))
        .when(way == 2, F.replace(x, F.lit(" "), F.lit("")))
        .when(way == 3, F.upper(x))
        .otherwise(F.left(x, F.floor(F.length(x) / 2).cast("int")))
    )
    box = F.array(*[F.lit(v) for v in (0.0, 0.0, 100.0, 10.0)])
    return rows.select(
        F.lit("corpus").alias("document"),
        F.col("doc_id").cast("int").alias("page_number"),
        F.col("i").alias("ordinal"),
        F.concat_ws("-", "doc_id", "i").alias("record_id"),
        F.lit("suspect_native_text").alias("kind"),
        F.when((F.col("doc_id") % 11) == 0, "failed").otherwise("completed").alias("status"),
        x.alias("native_candidate"),
        box.alias("bbox"),
        box.alias("native_bbox"),
        F.lit(0.0).alias("padding"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("double").alias("confidence"),
        F.array(F.struct(seen.alias("text"), F.lit(0.9).alias("confidence"), box.alias("pdf_bbox"))).alias("lines"),
    )


@query(
    _LINES
    + """select doc_id, i - 1 as line_no, agreement, case when doc_id % 11 = 0 then 'UNRESOLVED' when agreement is not null then 'AUTO_VERIFIED' else 'NEEDS_REVIEW' end as review_status,
         case when doc_id % 11 = 0 then 'failed' when agreement is not null then concat('normalized_', agreement, '_with_coordinate_overlap') else 'suspicious_native_ocr_mismatch' end as reason from r"""
)
def reconcile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconciliation.reconcile(_evidence(spark, sf_dir), similarity=False)
    return found.select(F.col("page_number").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("line_no"), "agreement", "review_status", "reason")


@query(
    _LINES
    + """select s.review_status, coalesce(n, 0) as n from (values ('AUTO_VERIFIED'), ('NEEDS_REVIEW'), ('UNRESOLVED')) s(review_status) left join
         (select case when doc_id % 11 = 0 then 'UNRESOLVED' when agreement is not null then 'AUTO_VERIFIED' else 'NEEDS_REVIEW' end as review_status, count(*) as n from r group by 1) c
         on c.review_status = s.review_status"""
)
def reconciliation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciliation.status_counts(reconciliation.reconcile(_evidence(spark, sf_dir), similarity=False))


@query()
def repair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all lines; the similarity in them is order-dependent and has no SQL form."""
    records = reconciliation.reconcile(_evidence(spark, sf_dir))
    page_rows = pages.from_documents(load(spark, sf_dir, "documents")).withColumn("trust", F.lit("medium"))
    found = reconciliation.decisions(records, page_rows)
    return found.select("page_number", "record_id", "candidate", "similarity", "support", "protected", "status", "reason")


_ISSUES = """
    with i as (
      select doc_id as page_number, 'text_repair_page' as category, 'NEEDS_REVIEW' as status from labels where quality = 0
      union all select doc_id, 'visual_markup_page', 'NEEDS_REVIEW' from labels where toxic = 1
      union all select doc_id, 'image_region_page', 'UNRESOLVED' from documents where contains(text, '@')
      union all select doc_id, 'unresolved_evidence_page', 'NEEDS_REVIEW' from documents where doc_id % 13 = 0)
"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    page = F.col("doc_id").cast("int").alias("page_number")
    corpus, id = F.lit("corpus").alias("document"), F.concat(F.lit("i"), "doc_id").alias("record_id")
    decisions = labels.where("quality = 0").select(corpus, page, id, F.lit("low_quality").alias("reason"), F.lit("REVIEW_REQUIRED").alias("status"))
    marks = labels.where("toxic = 1").select(corpus, page, id.alias("id"), F.lit("NEEDS_REVIEW").alias("review_status"))
    records = docs.where(F.col("text").contains("@")).select(corpus, page, id, F.lit("image_region").alias("kind"), F.lit("address").alias("reason"), F.lit("UNRESOLVED").alias("review_status"))
    other = docs.where("doc_id % 13 = 0").select(corpus, page, id, F.lit("unknown").alias("kind"), F.lit("sample").alias("reason"), F.lit("NEEDS_REVIEW").alias("review_status"))
    return review.issues(decisions, records.unionByName(other), marks)


@query(
    _ISSUES
    + """select page_number, string_agg(distinct category, ',' order by category) as categories, count(*) as n_issues,
         case when bool_or(status = 'UNRESOLVED') then 'UNRESOLVED' else 'NEEDS_REVIEW' end as status from i group by 1"""
)
def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.page_tasks(_issues(spark, sf_dir))
    return found.select(F.col("page_number").cast("long").alias("page_number"), F.array_join("review_categories", ",").alias("categories"), F.col("issue_count").alias("n_issues"), "status")


@query(_ISSUES + "select category, count(*) as n_issues, count(distinct page_number) as n_pages from i group by 1")
def review_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.category_counts(_issues(spark, sf_dir))


@query(
    r"""with c as (select d.source, d.doc_id, length(d.text) = d.n_chars as length_matches, not regexp_matches(d.text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') as no_control,
          l.doc_id is not null as labelled, length(d.text) >= 40 as long_enough from documents d left join labels l on l.doc_id = d.doc_id),
        r as (select source, 'length_matches' as name, bool_and(length_matches) as ok from c group by 1 union all select source, 'no_control', bool_and(no_control) from c group by 1
          union all select source, 'all_labelled', bool_and(labelled) from c group by 1 union all select source, 'long_enough', bool_and(long_enough) from c group by 1)
        select source, bool_and(ok) as valid, coalesce(string_agg(case when not ok then name end, ',' order by name), '') as failed, count(*) as n_checks from r group by 1"""
)
def canonical_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each source's documents rolled up to one verdict."""
    labels = load(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    rows = load(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy("source").agg(
        F.bool_and(F.length("text") == F.col("n_chars")).alias("length_matches"),
        F.bool_and(~text.has_bad_control(F.col("text"))).alias("no_control"),
        F.bool_and(F.coalesce("labelled", F.lit(False))).alias("all_labelled"),
        F.bool_and(F.length("text") >= 40).alias("long_enough"),
    )
    names = ("length_matches", "no_control", "all_labelled", "long_enough")
    checks = rows.select("source", F.explode(F.create_map(*[v for n in names for v in (F.lit(n), F.col(n))])).alias("check", "passed"))
    return review.validation(checks, "source").withColumn("failed", F.array_join("failed", ","))


@query(
    r"""select source as document, sha256(concat('---', chr(10), 'handoff_schema_version: 2', chr(10), 'source: {"document":"', source, '"}', chr(10), 'page_review_count: 0', chr(10), '---', chr(10), chr(10),
         '# Page Reading Pack', chr(10), chr(10), string_agg(concat('## PDF page ', doc_id, chr(10), chr(10), '- Text-layer trust: ', lang, chr(10), '- Text-layer origin: ', source, chr(10),
         '- Primary text source: reconciled_text', chr(10), '- Review categories: []', chr(10), chr(10), '### Primary Reading Text', chr(10), chr(10), regexp_replace(text, '\s+$', ''), chr(10)), chr(10) order by doc_id))) as markdown_sha256
       from documents group by 1"""
)
def handoff_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as one Markdown text, by its hash."""
    rows = load(spark, sf_dir, "documents").select(
        F.col("source").alias("document"), F.col("doc_id").alias("page_number"), F.col("lang").alias("trust"), F.col("source").alias("origin"), F.lit("reconciled_text").alias("canonical_source"),
        F.col("text").alias("canonical_text"), F.lit(None).cast("array<struct<record_id:string,kind:string,ocr_text:string,ocr_confidence:double,review_status:string>>").alias("supplements"),
        F.lit(None).cast("array<struct<id:string,color:string,review_status:string>>").alias("markers"), F.lit(None).cast("struct<review_categories:array<string>>").alias("task"),
    )
    return review.handoff_hash(rows)


@query(
    """with x as (select concat('d', doc_id) as evidence_id, doc_id % 7 as page_number, lang as kind, source as artifact, doc_id % 3 = 0 as review_required from documents where doc_id % 4 <> 1),
        r as (select concat('d', doc_id) as evidence_id, doc_id % 7 + toxic as page_number, 'en' as kind, concat('src', doc_id % 20) as artifact, quality = 1 as review_required, concat('label[', doc_id, ']') as location from labels),
        j as (select r.*, x.evidence_id is not null as known, x.page_number as p, x.kind as k, x.artifact as a, x.review_required as f from r left join x on x.evidence_id = r.evidence_id)
        select location, 'UNKNOWN_EVIDENCE_ID' as issue from j where not known union all select location, 'PAGE_MISMATCH' from j where known and p <> page_number
        union all select location, 'SOURCE_KIND_MISMATCH' from j where known and k <> kind union all select location, 'ARTIFACT_MISMATCH' from j where known and a <> artifact
        union all select location, 'REVIEW_FLAG_DROPPED' from j where known and f and not review_required"""
)
def evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as references to documents as evidence."""
    id, page = F.concat(F.lit("d"), "doc_id").alias("evidence_id"), F.col("doc_id") % 7
    index = review.evidence_index(
        load(spark, sf_dir, "documents").where("doc_id % 4 <> 1").select(id, page.alias("page_number"), F.col("lang").alias("kind"), F.col("source").alias("artifact"), (F.col("doc_id") % 3 == 0).alias("review_required"))
    )
    refs = load(spark, sf_dir, "labels").select(
        id, (page + F.col("toxic")).alias("page_number"), F.lit("en").alias("kind"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("artifact"), (F.col("quality") == 1).alias("review_required"), F.concat(F.lit("label["), "doc_id", F.lit("]")).alias("location")
    )
    return review.reference_issues(refs, index).select("location", "issue")


_SEARCH = r"""
    with q as (select item_id as query_id, lower(regexp_replace(text, '\s+', '', 'g')) as q from benchmark),
    n as (select doc_id as note_id, lower(source) as k_title, lower(regexp_replace(text, '\s+', '', 'g')) as k_body from documents),
    m as (select query_id, note_id, k_title = q as is_exact, case when contains(k_title, q) then 2::bigint else 4::bigint end as match_rank from q, n where contains(k_title, q) or contains(k_body, q)),
    g as (select *, bool_or(is_exact) over (partition by query_id) as any_exact from m)
    select query_id, note_id, match_rank, row_number() over (partition by query_id order by match_rank, note_id) as position from g where is_exact or not any_exact
"""


@query(_SEARCH)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries over all documents."""
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    notes = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("note_id"), F.col("source").alias("title"), F.lit(None).cast("array<string>").alias("aliases"), F.col("text").alias("body"))
    found = retrieval.search(queries, notes)
    return found.select("query_id", "note_id", F.col("match_rank").cast("long").alias("match_rank"), F.col("position").cast("long").alias("position"))


@query(
    """with asked as (select distinct r_name as law, case when c_custkey % 11 = 0 then 'x' else '第' || lpad((c_custkey % 40)::varchar, 3, '0') || '条' end as article, case when c_custkey % 11 <> 0 then c_custkey % 40 end as k
          from customer join region on r_regionkey = c_custkey % 5),
        t as (select r_name as law, n_nationkey as k, count(*) as n, min(n_name) as statute_id from nation join region on r_regionkey = n_regionkey group by 1, 2)
        select a.law, a.article, case when a.k is null then 'BAD_ARTICLE' when t.k is null then 'MISSING' else 'FOUND' end as outcome, coalesce(n, 0) as n_rows, t.statute_id
        from asked a left join t on t.law = a.law and t.k = a.k"""
)
def statute_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as articles of their region, asked for by customers."""
    nation, region, n = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region"), F.col("c_custkey")
    table = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("r_name").alias("law"), F.col("n_nationkey").cast("string").alias("article"), F.col("n_name").alias("statute_id"), F.col("n_name").alias("text")
    )
    article = F.when(n % 11 == 0, F.lit("x")).otherwise(F.concat(F.lit("第"), F.lpad((n % 40).cast("string"), 3, "0"), F.lit("条")))
    asked = load(spark, sf_dir, "customer").join(F.broadcast(region), n % 5 == F.col("r_regionkey")).select(F.col("r_name").alias("law"), article.alias("article"))
    return retrieval.statutes(asked.distinct(), table)


@query(
    """select distinct c_custkey as customer, 'missing' as side from customer where c_custkey % 10 <> 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')
       union all select distinct o_custkey, 'unexpected' from orders where o_orderstatus = 'F' and o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)"""
)
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine in ten customers against those of finished orders."""
    expected = load(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("customer"))
    return sets.difference(expected, load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("customer")), "customer")


@query("select p_name, count(*) as n from part group by 1 having count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.duplicates(load(spark, sf_dir, "part"), "p_name")


@query(
    """select name, sum(n_chars)::bigint as n_chars, sum(n_bytes)::bigint as n_bytes from (select source as name, length(text) as n_chars, strlen(text) as n_bytes from documents
       union all select 'total', length(text), strlen(text) from documents) group by 1"""
)
def text_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and bytes by source and over all."""
    rows = sinks.cost(load(spark, sf_dir, "documents").select(F.col("source").alias("name"), "text"))
    return rows.groupBy("name").agg(F.sum("n_chars").alias("n_chars"), F.sum("n_bytes").alias("n_bytes"))


@query("select doc_id::varchar as name, case when doc_id % 2 = 1 then 'PUBLISH' when doc_id % 6 = 0 then 'REFUSE' else 'ALREADY_PUBLISHED' end as action from documents")
def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents are published already, each sixth with other content."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"), "doc_id")
    published = docs.where("doc_id % 2 = 0").select("name", F.when(F.col("doc_id") % 6 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return sinks.publication(docs.drop("doc_id"), published).select("name", "action")


@query("select source as packet, concat(doc_id, '.txt') as member, sha256(text) as member_sha256, strlen(text) as member_size, true as safe from documents")
def packet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of ZIP packets made of each source's documents, read back."""
    rows = load(spark, sf_dir, "documents").select(F.col("source").alias("packet"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.col("text").alias("content"))
    built = sinks.packets(rows)
    return files.zip_members(built.select(F.col("packet").alias("path"), "content"), content=False).select(F.col("path").alias("packet"), "member", "member_sha256", "member_size", "safe")


@query(
    r"""select concat('n', doc_id) as note_id, source as title, 2::bigint as n_aliases, lang as subject, length(text) as n_body from documents where trim(text, chr(10) || ' ') <> ''"""
)
def note_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown notes with frontmatter, parsed again."""
    head = F.concat(F.lit("---\r\npattern_id: n"), F.col("doc_id").cast("string"), F.lit("\r\ntitle: "), "source", F.lit("\r\nsubject: "), "lang", F.lit("\r\ntype: pattern\r\naliases: [a, b]\r\n---\r\n"), "text")
    notes = load(spark, sf_dir, "documents").select(head.alias("text"))
    found = files.patterns(notes, "pattern")
    return found.select("note_id", "title", F.size("aliases").cast("long").alias("n_aliases"), "subject", F.length("body").cast("long").alias("n_body"))


@query(
    """with p as (select doc_id, text, lang, case when doc_id % 3 = 0 then 'low' else 'high' end as trust, case when doc_id % 6 = 0 then concat('OCR ', text) end as page_ocr from documents)
       select doc_id, case when trust <> 'low' then 'reconciled_text' when coalesce(page_ocr, '') <> '' then 'full_page_ocr' else 'unavailable_requires_visual_review' end as canonical_source,
              sha256(case when trust <> 'low' then text else page_ocr end) as canonical_sha256 from p"""
)
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that stands for a page: its own, or the recognised one where its layer isn't trusted."""
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("reconciled_text"), F.when(F.col("doc_id") % 3 == 0, "low").otherwise("high").alias("trust"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("OCR "), "text")).alias("page_ocr")
    )
    return markers.canonical_text(rows).select("doc_id", "canonical_source", "canonical_sha256")
