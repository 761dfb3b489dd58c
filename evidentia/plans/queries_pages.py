"""Page text, identity, trust and alignment over the driver's documents and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import hashing, text
from evidentia.operators import alignment, headings, pages
from evidentia.plans.registry import query
from evidentia.session import load
from evidentia.sources import files

_EXTRA = text.expected_extra()
_PLAIN = r"regexp_replace(text, '\s+', ' ', 'g')"

#: Measures of text t of column `text`, for RE2 on text whose only whitespace is space and LF.
_MEASURED = rf"""
    select doc_id, text,
           length(regexp_replace(text, '[\s]', '', 'g')) as seen,
           length(regexp_replace(text, '[\s\p{{Cc}}]', '', 'g')) as useful,
           length(regexp_replace(text, '[\s\p{{C}}]', '', 'g')) as printable,
           length(regexp_replace(text, '[^{text.CJK}]', '', 'g')) as script,
           length(regexp_replace(text, '[^\p{{L}}\p{{N}}\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]', '', 'g'))
             - length(regexp_replace(text, '[^{text.CJK}{_EXTRA}]', '', 'g')) as suspicious,
           len(list_filter(regexp_extract_all(text, '[A-Za-z]+'),
               lambda t: regexp_full_match(t, '[a-z]{{2,12}}') and t not in ('rank', 'stock', 'memo'))) as noise
    from documents
"""
_QUALITY = "case when seen = 0 then 0.0 else round(greatest(0.0, least(1.0, printable / seen - least(0.85, suspicious * 3.0 / seen))), 4) end"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.from_documents(load(spark, sf_dir, "documents"))


@query(rf"select doc_id, sha256(trim({_PLAIN})) as text_sha256, length(trim({_PLAIN})) as n_chars from documents")
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content fingerprint of each page."""
    found = pages.identity(_pages(spark, sf_dir))
    return found.select(
        F.col("page_number").cast("long").alias("doc_id"),
        F.col("text_fingerprint").alias("text_sha256"),
        F.length("normalized_text").cast("long").alias("n_chars"),
    )


_VERSIONS = rf"""
    with p as (select doc_id, sha256(trim({_PLAIN})) as page_hash from documents),
    v1 as (select *, row_number() over (partition by page_hash order by doc_id) rn from p where doc_id % 10 <> 3),
    v2 as (select *, row_number() over (partition by page_hash order by doc_id) rn from p where doc_id % 10 <> 7),
    aligned as (
      select v1.doc_id as previous_page, v2.doc_id as current_page,
             case when v1.doc_id is null then 'NEW' when v2.doc_id is null then 'DELETED'
                  when v1.doc_id = v2.doc_id then 'SAME' else 'MOVED' end as classification
      from v1 full outer join v2 on v1.page_hash = v2.page_hash and v1.rn = v2.rn)
"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.identity(_pages(spark, sf_dir), nfkc=False)
    return alignment.exact(found.where("page_number % 10 <> 3"), found.where("page_number % 10 <> 7"))


@query(_VERSIONS + "select previous_page, current_page, classification from aligned")
def version_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two corpus versions, paired as bags of equal content."""
    numbers = [F.col(c).cast("long").alias(c) for c in ("previous_page", "current_page")]
    return _aligned(spark, sf_dir).select(*numbers, "classification")


@query(_VERSIONS + "select classification, count(*) as n_pages from aligned group by 1")
def version_alignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n_pages"))


@query(_VERSIONS + "select distinct current_page from aligned where classification not in ('SAME', 'MOVED') and current_page is not null")
def changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.changed_pages(_aligned(spark, sf_dir))
    return found.select(F.col("current_page").cast("long").alias("current_page"))


@query()
def approx_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full alignment of each source's documents with a version in which some are edited and some are gone."""
    docs = load(spark, sf_dir, "documents")
    edited = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" Amended."))).otherwise(F.col("text"))
    shape = lambda df, body: pages.identity(pages.from_documents(df.where("doc_id is not null").withColumn("text", body), F.col("source")), nfkc=False)
    old, new = shape(docs, F.col("text")), shape(docs.where("doc_id % 100 <> 7"), edited)
    return alignment.align(old, new).select("document", "previous_page", "current_page", "classification", "similarity", "reusable")


@query(
    rf"""select doc_id, useful as n_useful, suspicious as n_suspicious, noise as n_noise,
         {_QUALITY} as quality, case when seen = 0 then 0.0 else round(script / seen, 6) end as script_ratio
         from ({_MEASURED})"""
)
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    rows = load(spark, sf_dir, "documents").select("doc_id", text.profile(F.col("text")).alias("p"), text.noise_count(F.col("text")).alias("noise"))
    return rows.select(
        "doc_id",
        p["useful"].cast("long").alias("n_useful"),
        p["suspicious"].cast("long").alias("n_suspicious"),
        F.col("noise").cast("long").alias("n_noise"),
        text.profile_quality(p).alias("quality"),
        F.round(text.profile_script_ratio(p), 6).alias("script_ratio"),
    )


@query(
    r"""select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct, list_min(t) as first_token from (
          select doc_id, list_filter(regexp_extract_all(text, '[A-Za-z]+'),
            lambda t: regexp_full_match(t, '[a-z]{2,12}') and t not in ('rank', 'stock', 'memo')) as t from documents)"""
)
def noise_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "documents").select("doc_id", text.noise_tokens(F.col("text")).alias("t"))
    distinct = F.size(F.array_distinct("t")).cast("long").alias("n_distinct")
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), distinct, F.array_min("t").alias("first_token"))


_TRUST = rf"""
    with m as ({_MEASURED}),
    q as (select *, {_QUALITY} as quality, case when seen = 0 then 0.0 else round(suspicious / seen, 6) end as ratio,
          len(list_filter(string_split(text, chr(10)), lambda x:
            length(regexp_replace(x, '[^\p{{L}}\p{{N}}\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]', '', 'g'))
            - length(regexp_replace(x, '[^{text.CJK}{_EXTRA}]', '', 'g')) > 0)) as regions from m),
    t as (select *, case when useful = 0 then 'low'
            when ratio >= 0.01 or suspicious >= 8 or regions >= 4 then 'low'
            when suspicious > 0 or quality < 0.95 then 'medium' when quality >= 0.98 then 'high' else 'medium' end as trust,
          case when useful = 0 then 'unknown'
            when ratio >= 0.01 or suspicious >= 8 or regions >= 4 then 'embedded_ocr_or_corrupt_mapping_likely'
            when suspicious > 0 or quality < 0.95 then 'unknown' when quality >= 0.98 then 'born_digital_likely' else 'unknown' end as origin from q)
"""


@query(_TRUST + "select doc_id, trust, origin, regions as n_regions, case when useful < 120 or quality < 0.82 or trust = 'low' then 'ocr_required' else 'native' end as page_mode from t")
def text_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust, origin and mode of each page; no expected script here, so noise tokens don't count."""
    found = pages.assessed(_pages(spark, sf_dir))
    return found.select(
        F.col("page_number").cast("long").alias("doc_id"), "trust", "origin", F.col("suspect_regions").cast("long").alias("n_regions"), F.col("mode").alias("page_mode")
    )


@query(
    rf"""select doc_id, line_no, glyphs from (
          select doc_id, line_no - 1 as line_no, length(regexp_replace(x, '[^\p{{L}}\p{{N}}\x{{E000}}-\x{{F8FF}}\x{{FFFD}}]', '', 'g'))
            - length(regexp_replace(x, '[^{text.CJK}{_EXTRA}]', '', 'g')) as glyphs
          from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents))
        where glyphs > 0"""
)
def suspect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.suspect_lines(_pages(spark, sf_dir))
    return found.select(F.col("page_number").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line_no"), F.col("glyphs").cast("long").alias("glyphs"))


@query("select c as char, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(string_split(text, '')) as c from documents) where c <> '' group by 1")
def char_explode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every character and the pages that have it; tasks hand on one row a character."""
    docs = load(spark, sf_dir, "documents").select(F.split("text", "").alias("chars"))
    counted = lambda chars, name: docs.select(F.explode(chars).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias(name))
    return counted(F.col("chars"), "n").join(counted(F.array_distinct("chars"), "n_docs"), "char")


@query(r"select doc_id, regexp_matches(text, '[項号年月日円]|懲役|禁錮|拘禁刑|最判|大判|判例|事件|昭和|平成|令和|\p{Nd}') as is_protected from documents")
def protected_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.is_protected(F.col("text"), F.col("text")).alias("is_protected"))


@query(
    r"""select doc_id, start_char, stop_char from (
          select doc_id, x, start_char, start_char + length(x) as stop_char from (
            select doc_id, x, coalesce(sum(length(x) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start_char
            from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)))
        where x <> ''"""
)
def line_cursor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line that isn't empty is found when searched from the end of the one before."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    found = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.line_ranges(F.col("text"), lines)).alias("r"))
    return found.select("doc_id", F.col("r.start").cast("long").alias("start_char"), F.col("r.stop").cast("long").alias("stop_char"))


@query(
    r"""with l as (select doc_id, text, string_split(text, chr(10))[1] as first_line from documents),
        p as (select *, strpos(text, first_line) as hit from l)
        select doc_id, case when first_line <> '' and strpos(substring(text, hit + 1), first_line) = 0 then hit - 1 end as start_char,
               case when first_line <> '' and strpos(substring(text, hit + 1), first_line) = 0 then hit - 1 + length(first_line) end as stop_char from p"""
)
def unique_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line's range where it occurs only once in its page."""
    found = text.unique_range(F.col("text"), F.get(F.split("text", "\n"), F.lit(0)))
    rows = load(spark, sf_dir, "documents").select("doc_id", found.alias("r"))
    return rows.select("doc_id", F.col("r.start").cast("long").alias("start_char"), F.col("r.stop").cast("long").alias("stop_char"))


@query(
    r"""select doc_id, n - 1 as slice_no, length(s) as n_chars, sha256(s) as slice_sha256 from (
          select doc_id, n, substring(text, (n - 1) * 1800 + 1, 1800) as s
          from documents, generate_series(1, 1000) as g(n) where n <= ceil(length(text) / 1800))"""
)
def text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in slices of 1800 characters."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.slices(F.col("text"))).alias("slice_no", "s"))
    return rows.select("doc_id", F.col("slice_no").cast("long").alias("slice_no"), F.length("s").cast("long").alias("n_chars"), hashing.text_hash(F.col("s")).alias("slice_sha256"))


@query(
    r"""select doc_id, sha256(concat_ws(chr(0), doc_id::varchar, lang, source)) as chained,
               sha256(concat('{"lang":"', lang, '","source":"', source, '"}')) as payload,
               concat(lang, '/', source, '-', left(sha256(text), 12), '-', left(sha256(source), 12)) as run_dir from documents"""
)
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained and canonical-payload hashes, and a run directory made of hashes."""
    sha = lambda c: hashing.text_hash(F.col(c))
    return load(spark, sf_dir, "documents").select(
        "doc_id",
        hashing.chained_hash(F.col("doc_id"), F.col("lang"), F.col("source")).alias("chained"),
        hashing.payload_hash(source=F.col("source"), lang=F.col("lang")).alias("payload"),
        hashing.run_directory(F.col("lang"), F.col("source"), sha("text"), sha("source")).alias("run_dir"),
    )


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""
_DECODED = rf"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({_HTML},
  '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"""


@query(rf"select page_id, t as page_text, length(t) as n_chars from (select page_id, trim(regexp_replace(regexp_replace({_DECODED}, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) as t from pages)")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of web pages."""
    found = load(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("page_text"))
    return found.withColumn("n_chars", F.length("page_text").cast("long"))


@query(r"""select page_id, left(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1F]+', '-', 'g'), '^[. ]+|[. ]+$', '', 'g'), 80) as file_name from pages""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of addresses."""
    return load(spark, sf_dir, "pages").select("page_id", text.safe_component(F.col("url")).alias("file_name"))


@query(
    """select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over
         (partition by conv_id order by turn range between 16 preceding and current row) as heading_turn from conversations"""
)
def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest user turn at or before each turn, 16 back at most."""
    found = headings.nearest_preceding(load(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", "turn")
    return found.select("conv_id", "turn", F.col("nearest").alias("heading_turn"))


_HEADING_ROWS = [
    (2, "続き", True), (3, "第2問\n目次", False), (4, "本文", True), (5, "第 3 問 甲説\nMEMO", False),
    (6, "本文", True), (8, "本文", True), (9, "第4問\n第5問", True), (10, "参照は第9問を見よ", True),
]


@query(
    """with c as (select c_custkey as k, (c_custkey % 90 + 1)::varchar as q, c_custkey % 2 = 0 as odd_heading from customer), p as (select *, unnest([2, 4, 6, 8, 9, 10]) as done_page from c),
       r as (select *, done_page <= 6 or (done_page = 8 and not odd_heading) as resolved from p)
       select k, done_page, resolved, case when resolved then q end as question, case when resolved then 1 end as start_page, case when resolved then 'RESOLVED' else 'UNRESOLVED_AMBIGUOUS_HEADING' end as reason from r"""
)
def heading_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done pages of each customer's document with the question whose heading precedes them; even ones have a heading nobody can read."""
    page = lambda n, t, done: F.struct(F.lit(n).alias("page_number"), t.alias("text"), F.lit(done).alias("done"))
    k = F.col("c_custkey")
    first = page(1, F.concat(F.lit("第"), (k % 90 + 1).cast("string"), F.lit("問\n次の事例について論ぜよ")), False)
    seventh = F.when(k % 2 == 0, F.lit("第?問")).otherwise(F.lit("本文"))
    rows = F.array(first, page(7, seventh, False), *[page(n, F.lit(t), done) for n, t, done in _HEADING_ROWS])
    rows = load(spark, sf_dir, "customer").select(k.cast("string").alias("document"), F.explode(rows).alias("p")).select("document", "p.*")
    found = headings.resolve(rows)
    return found.select(F.col("document").cast("long").alias("k"), *[F.col(c).cast("long").alias(c) for c in ("done_page", "start_page")], "resolved", "question", "reason")
