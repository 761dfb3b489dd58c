"""The corpus operators' queries over the driver tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import (
    decontaminate,
    language,
    licenses,
    mixing,
    personal,
    quality,
    scoring,
    secrets,
    simhash,
    substrings,
)
from evidentia.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _matches(kind: str, rank: int, pattern: str, keep: str = "true", more: str = "") -> str:
    """SQL for spans (doc_id, kind, rank, start, stop) of the matches of `pattern` that `keep` holds for, as match m.

    A match starts after all gaps up to it and all matches before it.
    """
    return rf"""
      select doc_id, '{kind}' as kind, {rank} as rank, a::bigint as start, (a + length(m))::bigint as stop{', ' * bool(more)}{more} from (
        select doc_id, m, sum(length(g)) over w + coalesce(sum(length(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as a
        from (select doc_id, unnest(regexp_extract_all(text, '{pattern}')) as m, unnest(string_split_regex(text, '{pattern}')) as g,
                unnest(range(1, 2 + len(regexp_extract_all(text, '{pattern}')))) as i from t where regexp_matches(text, '{pattern}'))
        window w as (partition by doc_id order by i)) where m is not null and {keep}"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(load(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies") + F.col("part")).alias("taken"),
        F.array_join("shards", ",").alias("shards"),
    )


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_IDENTIFIER = r"""(?i)\b(?:user(?:name)?|login|client_?id|account(?:_?id)?)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
_ENDPOINT = r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x00-\x20"''<>]+"""
_MIXED = "length(m) >= 20 and regexp_matches(m, '[a-z]') and regexp_matches(m, '[0-9]')"

ORACLE_SQL["op7_secret_scan"] = rf"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    base as ({_matches("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
      union all {_matches("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
      union all {_matches("hex", 2, "[0-9a-f]+", "length(m) >= 24")}),
    weak as ({_matches("linked_id", 3, _IDENTIFIER)}
      union all {_matches("linked_secret", 4, "[A-Za-z0-9+/_=-]+", _MIXED)}
      union all {_matches("linked_endpoint", 5, _ENDPOINT)}),
    part as (select *, case when kind in ('access', 'linked_id') then 'i' when kind = 'linked_endpoint' then 'o' else 's' end as side from (from base union all from weak)),
    placed as (select p.*, len(regexp_extract_all(substring(text, 1, start), '\n[\x20\t\r]*\n')) as block from part p join t on t.doc_id = p.doc_id),
    extra as (select distinct a.doc_id, a.kind, a.rank, a.start, a.stop from placed a join placed b on b.doc_id = a.doc_id
        and case when a.side = 's' then b.side in ('i', 'o') else b.side = 's' end
        and greatest(a.start - b.stop, b.start - a.stop) <= case when a.block = b.block then 2000 else 400 end
      where a.kind like 'linked%' and not exists (select 1 from base c where c.doc_id = a.doc_id and c.start < a.stop and a.start < c.stop)),
    b as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as joined from base group by 1),
    e as (select doc_id, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as joined from (from base union all from extra) group by 1)
    select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(b.joined, '')) as base_sha256, coalesce(e.joined, '') as spans from t left join b on b.doc_id = t.doc_id left join e on e.doc_id = t.doc_id
"""


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(load(spark, sf_dir, "documents"))


ORACLE_SQL["op8_quality_rules"] = r"""
    with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
    t as (select doc_id, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
    d as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from t) where n > 1),
    c as (select doc_id, count(distinct p) as r from (select doc_id, unnest([i, i + 1, i + 2]) as p from d) group by 1),
    m as (select w.doc_id, source, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
            coalesce(r, 0) as n_repeat_words, len(ls) as n_lines from w left join c on c.doc_id = w.doc_id),
    f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
    j as (select *, base_failed or n_symbols > n_words * 0.5 or word_chars / greatest(n_words, 1) < 2 or word_chars / greatest(n_words, 1) > 15
            or 100 * n_dup_lines > 50 * n_lines as rule_failed from f),
    h as (select source, count(*) as n, count(*) filter (rule_failed) as bad from j group by 1),
    p as (select avg(bad / n) as mu, coalesce(var_samp(bad / n), 0) - avg(bad / n) * (1 - avg(bad / n)) * avg(1 / n) as excess, sum(n) as everything from h),
    q as (select mu, greatest(1, case when excess > 0 then greatest(1, mu * (1 - mu) / excess - 1) else everything end) as strength from p),
    r as (select source, (bad + mu * strength) / (n + strength) as rate, n + strength as weight, mu from h, q),
    v as (select source, rate, mu, greatest(0, rate - 2 * sqrt(rate * (1 - rate) / (weight + 1))) as low from r)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not rule_failed and low * (1 - mu) <= 3 * mu * (1 - low) as kept,
           rule_failed, round(rate, 6) as host_rate from j join v on v.source is not distinct from j.source
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "rule_failed",
        F.round("host_rate", 6).alias("host_rate"),
    )


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = language.held_out(F.col("doc_id"))
    found = language.predict(docs, language.sample(docs.where(~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "accepted")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.shared_documents(load(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(load(spark, sf_dir, "documents"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    figures = ("target_bits", "background_bits", "corpus_bits", "score")
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in figures])


_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LUHN = """length(regexp_replace(m, '[^0-9]', '', 'g')) between 14 and 19 and list_sum(list_transform(
    range(0, length(regexp_replace(m, '[^0-9]', '', 'g'))), lambda k: case when k % 2 = 0 then 1 else 2 end
      * substring(reverse(regexp_replace(m, '[^0-9]', '', 'g')), k + 1, 1)::int
      - case when k % 2 = 1 and substring(reverse(regexp_replace(m, '[^0-9]', '', 'g')), k + 1, 1)::int > 4 then 9 else 0 end)) % 10 = 0"""
_BYTES = "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(right(concat('0', ltrim(p, '0')), 4) as int), 999) > 255)) = 0"
_TERMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(%s, '{_LETTERS}'), lambda w: lower(w)), lambda w: length(w) >= 3))"

ORACLE_SQL["op6_personal_data"] = rf"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    base as ({_matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")}
      union all {_matches("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _BYTES)}
      union all {_matches("card", 2, r"[0-9]([\x20-]?[0-9])+", _LUHN)}
      union all {_matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) between 10 and 15")}),
    placed as (select b.*, t.text, greatest(start - 150, 0) as lo, least(stop + 150, length(t.text)) as hi from base b join t on t.doc_id = b.doc_id),
    around as (select text, kind, substring(text, start + 1, stop - start) as value, concat(
        case when lo > 0 then regexp_replace(substring(text, lo + 1, start - lo), '^{_LETTERS}', '') else substring(text, lo + 1, start - lo) end, ' ',
        case when hi < length(text) then regexp_replace(substring(text, stop + 1, hi - stop), '{_LETTERS}$', '') else substring(text, stop + 1, hi - stop) end) as context from placed),
    pair as (select distinct text, kind, unnest([value, '']) as value, unnest([term, term]) as term
      from (select text, kind, value, unnest({_TERMS % "context"}) as term from around)),
    split as (select text, string_split_regex(text, '[\x20\x09-\x0D]+') as w from (select distinct text from around)),
    digest as (select text, unnest(list_transform(range(1, len(w) + 1), lambda i: md5(concat_ws(' ', w[i], w[i + 1], w[i + 2])))) as h from split),
    sketch as (select text, min(substring(h, 1, 16)) as a, min(substring(h, 17, 16)) as b from digest group by 1),
    beside as (select term, kind, value, count(*) as n_beside, least(count(distinct a), count(distinct b)) as support
      from pair p join sketch s on s.text = p.text group by all having support >= 3),
    entity as (select kind, value, count(*) as n_entity from (select distinct text, kind, unnest([value, '']) as value from around) group by all),
    term as (select term, count(*) as df from (select unnest({_TERMS % "text"}) as term from (select distinct text from documents where text is not null))
      where term in (select term from beside) group by 1),
    measured as (select b.*, n_beside / df as q, n_entity / n as p, df, (select count(*) from beside) as tested
      from beside b join entity e on e.kind = b.kind and e.value = b.value join term f on f.term = b.term
      cross join (select count(distinct text) as n from documents) where n_entity < n),
    risky as (select *, 1 - log2(q) / log2(p) as d from measured where 1 - log2(q) / log2(p) >= 0.8
      and support / q * (q * log2(q / p) + case when q < 1 then (1 - q) * log2((1 - q) / (1 - p)) else 0 end) >= log2(tested) + 7),
    worst as (select text, p.term, max(d) as d from pair p join risky r on r.term = p.term and r.kind = p.kind and r.value = p.value group by all),
    word as (select m.*, t.text from ({_matches("word", 4, _LETTERS, "true", "lower(m) as term")}) m join t on t.doc_id = m.doc_id),
    extra as (select w.doc_id, case when d >= 0.95 then 'term_removed' else 'term_generalised' end as kind, 4 as rank, start, stop
      from word w join worst x on x.text = w.text and x.term = w.term
      where not exists (select 1 from base c where c.doc_id = w.doc_id and c.start < w.stop and w.start < c.stop)),
    b as (select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card,
        count(*) filter (kind = 'phone') as n_phone, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as joined from base group by 1),
    e as (select doc_id, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as joined from (from base union all from extra) group by 1)
    select t.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
      sha256(coalesce(b.joined, '')) as base_sha256, coalesce(e.joined, '') as spans from t left join b on b.doc_id = t.doc_id left join e on e.doc_id = t.doc_id
"""


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(load(spark, sf_dir, "documents"))
