"""Quality rules judged by host, in DataFrame expressions only.

Each document is tried by rules. Failures are summed by host (here the source column), each
host's failure rate is shrunk to the rate of all hosts by a beta prior fitted to the hosts
themselves, and the verdict on the host is joined back to its documents: a host is rejected
where even the low end of its shrunk rate is far worse than what hosts have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.binding import let
from evidentia.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules beside the base ones; a document fails by any of them.
MAX_SYMBOLS_PER_WORD = 0.5
WORD_LENGTHS = (2.0, 15.0)
MAX_DUP_LINE_PERCENT = 50
#: A host is rejected with all its documents if the odds of failure at the low end of its shrunk
#: rate, so many standard deviations below the mean, pass so many times the common odds.
DEVIATIONS = 2.0
MAX_ODDS = 3.0


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def from_windows(windows: Column) -> Column:
        def marked(order: Column) -> Column:
            same = lambda x, i: (F.get(order, i - 1)["h"] == x["h"]) | (F.get(order, i + 1)["h"] == x["h"])
            twice = F.filter(order, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
            places = F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(places)))

        numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            let(F.sort_array(numbered), marked)
        )

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(F.slice(hashed, 1, F.greatest(F.size(w) - 2, F.lit(0))), from_windows)

    return let(words, windows)


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null is empty."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        counts = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
        return let(
            counts,
            lambda c: F.struct(
                c["n"].cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                dup_lines.cast("long").alias("n_dup_lines"),
                c["r"].cast("long").alias("n_repeat_words"),
                (F.size(lines)).cast("long").alias("n_lines"),
            ),
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * MAX_REPEAT_PERCENT)


def rule_failed(m) -> Column:
    """Whether a document with measures `m` (a struct column) fails any rule."""
    mean = m["word_chars"] / F.greatest(m["n_words"], F.lit(1))
    return (
        base_failed(m["n_words"], m["n_repeat_words"])
        | (m["n_symbols"] > m["n_words"] * MAX_SYMBOLS_PER_WORD)
        | (mean < WORD_LENGTHS[0])
        | (mean > WORD_LENGTHS[1])
        | (m["n_dup_lines"] * 100 > m["n_lines"] * MAX_DUP_LINE_PERCENT)
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate, low, host_rejected) from (host, failed).

    The prior Beta(a, b) has the mean and the spread of the hosts' rates, by moments with each
    host weighed alike; a spread that chance alone explains gives a prior as strong as all hosts
    together, so that every host gets close to the common rate. low is the low end of the host's
    posterior. A null host is a host of its own.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("raw", F.col("n_failed") / F.col("n_docs"))
    prior = hosts.agg(
        F.avg("raw").alias("mean"),
        F.coalesce(F.var_samp("raw"), F.lit(0.0)).alias("spread"),
        F.avg(1 / F.col("n_docs")).alias("inverse"),
        F.sum("n_docs").alias("all_docs"),
    )
    within = F.col("mean") * (1 - F.col("mean"))
    excess = F.col("spread") - within * F.col("inverse")
    strength = F.when(excess > 0, F.greatest(within / excess - 1, F.lit(1.0))).otherwise(F.col("all_docs").cast("double"))
    prior = prior.select("mean", F.greatest(strength, F.lit(1.0)).alias("strength"))
    hosts = hosts.join(F.broadcast(prior), how="cross")  # one row of prior
    weight = F.col("n_docs") + F.col("strength")
    hosts = hosts.withColumn("rate", (F.col("n_failed") + F.col("mean") * F.col("strength")) / weight)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    hosts = hosts.withColumn("low", F.greatest(F.col("rate") - DEVIATIONS * deviation, F.lit(0.0)))
    # odds compared without dividing: low / (1 - low) > MAX_ODDS * mean / (1 - mean)
    worse = F.col("low") * (1 - F.col("mean")) > MAX_ODDS * F.col("mean") * (1 - F.col("low"))
    return hosts.select("host", "n_docs", "n_failed", "rate", "low", worse.alias("host_rejected"))


def judge(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """A row for every row of `docs`: doc_id, host, measures, base_failed, rule_failed, host_rate, kept.

    A document is kept if it passes all rules and its host isn't rejected; a rejected host's
    documents all go. A null host is a host of its own; a null text is empty, and fails; a null
    doc_id stays null; repeated rows each count and get a row; columns but doc_id, text and the
    host aren't read, whatever their names.
    """
    measured = docs.select("doc_id", F.col(host_col).cast("string").alias("host"), measures(F.col("text")).alias("m"))
    measured = measured.select(
        "doc_id",
        "host",
        "m.*",
        base_failed(F.col("m.n_words"), F.col("m.n_repeat_words")).alias("base_failed"),
        rule_failed(F.col("m")).alias("rule_failed"),
    )
    measured = stage(measured, "measures")
    hosts = stage(host_verdicts(measured.select("host", F.col("rule_failed").alias("failed"))), "hosts")
    hosts = hosts.select(F.col("host").alias("judged_host"), F.col("rate").alias("host_rate"), "host_rejected")
    rows = measured.join(hosts, F.col("host").eqNullSafe(F.col("judged_host")), "left").drop("judged_host")
    return rows.withColumn("kept", ~F.col("rule_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """The rows of `docs` that the rules and their hosts' verdicts keep, in the same columns (see `judge`).

    Measures are taken twice, once for the hosts and once beside the text, so texts aren't shuffled.
    """
    judged = docs.select(F.col(host_col).cast("string").alias("host"), rule_failed(measures(F.col("text"))).alias("failed"))
    hosts = stage(host_verdicts(judged), "hosts").where("host_rejected").select(F.col("host").alias("rejected_host"))
    rows = docs.select(F.struct("*").alias("row"), measures(F.col("text")).alias("m"))
    rows = rows.where(~rule_failed(F.col("m")))
    host = F.col(f"row.{host_col}").cast("string")
    return rows.join(hosts, host.eqNullSafe(F.col("rejected_host")), "left_anti").select("row.*")
