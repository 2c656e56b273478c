"""Quality rules with host-level verdicts, in column functions only.

Each text is measured in one narrow pass. Failures are counted by host (``source``), the hosts'
failure rates are shrunk by a beta prior fitted to all hosts, and the verdict on a host returns
to its documents: on a condemned host a document must pass every rule, elsewhere only the base
rules. A document that passes all rules is kept wherever it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import fresh, query, table
from rowwarden.operators.joins import skew_join
from rowwarden.session import stored

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MAX_SYMBOLS = 50  # percent of the words
MAX_DUP_LINES = 30  # percent of the lines with a word
ABOVE = 1 + 1e-9  # a host at the common rate is not above it, whatever the rounding
STRENGTH = (1.0, 1e6)  # bounds of the fitted prior's weight, in documents

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _removed(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name`` of the measures and ``n_lines``; null is an empty text.

    The steps are separate projections so that every array is built once. Repeated windows are
    looked for by their 64-bit hashes within one text; only texts that repeat one sort them."""
    words, lines, hashes, again = fresh(docs, "words", "lines", "hashes", "again")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.size(words)
    cut = docs.withColumn(words, F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    cut = cut.withColumn(lines, F.filter(F.split(body, "\n"), lambda line: F.trim(line, F.lit(SPACES)) != ""))
    cut = cut.withColumn(hashes, F.transform(
        F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))
    # the places of the windows that another window of the text equals; windows sorted by hash meet their equals
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cut = cut.withColumn(again, F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed))
    near = lambda at, by: F.get(again, at + by)["h"]
    twice = F.filter(again, lambda x, at: x["h"].eqNullSafe(near(at, -1)) | x["h"].eqNullSafe(near(at, 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.sequence(x["i"], x["i"] + (WINDOW - 1))))))
    return cut.withColumn(name, F.struct(
        n.cast("long").alias("n_words"),
        _removed(body, SPACES).cast("long").alias("word_chars"),
        (F.length(body) - _removed(body, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when((n < WINDOW + 1) | F.col(again).isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        # not deterministic for the optimizer, which would else copy all the above into filters on it
        F.spark_partition_id().alias("part"),
    )).drop(words, lines, hashes, again)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def any_failed(m: Column) -> Column:
    """The base rules, too many symbols, or too many repeated lines."""
    return (base_failed(m) | (100 * m["n_symbols"] > MAX_SYMBOLS * m["n_words"])
            | (100 * m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"]))


def host_verdicts(judged: DataFrame) -> DataFrame:
    """(host, failed) rows to (host, n, n_failed, rate, condemned); a null host is a host.

    Beta prior by moments: mean of all documents, variance between hosts beyond what their sizes
    explain. Without such variance every host takes the common rate, up to the bound of the prior's weight. A host is condemned
    when its shrunk rate lies above the common one."""
    hosts = stored(judged.groupBy("host").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("n_failed")), "hosts")
    total = hosts.agg(
        F.sum("n").alias("docs"), F.sum("n_failed").alias("bad"), F.count("*").alias("hosts"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n")).alias("spread"))
    mean = F.col("bad") / F.col("docs")
    noise = mean * (1 - mean)
    between = ((F.col("spread") - F.col("bad") * mean) - (F.col("hosts") - 1) * noise) / F.nullif(
        F.col("docs") - F.col("squares") / F.col("docs"), F.lit(0))
    weight = F.when(between > 0, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), noise / between - 1)))
    prior = total.select(mean.alias("mean"), F.coalesce(weight, F.lit(STRENGTH[1])).alias("weight"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    # the prior is one row
    return hosts.join(F.broadcast(prior)).select("host", "n", "n_failed", rate.alias("rate"), (rate > F.col("mean") * ABOVE).alias("condemned"))


def _with_verdicts(rows: DataFrame, host: str, verdicts: DataFrame, flag: str, rate: str) -> DataFrame:
    """Adds the verdict on each row's host and its rate. A host that holds much of the table is split by the join."""
    known = stored(verdicts.select(F.col("host").alias(host), "n", F.col("condemned").alias(flag), F.col("rate").alias(rate)), "verdicts")
    return skew_join(rows, known.drop("n"), [host], "left", null_safe=True, sizes=known.select(host, "n"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the five measures, base_failed, kept, host_condemned, host_rate) for each row of ``docs`` (doc_id, text, source).

    A null text is an empty text and fails; a null source is a host of its own; repeated rows are
    judged as often as they occur; other columns are not read; an empty table gives no rows."""
    rows = measured(docs.select("doc_id", "text", F.col("source").alias("host")), "m").select("doc_id", "host", "m")
    rows = stored(rows, "measures")
    verdicts = host_verdicts(rows.select("host", any_failed(F.col("m")).alias("failed")))
    joined = _with_verdicts(rows, "host", verdicts, "condemned", "rate")
    return joined.select(
        "doc_id", *[f"m.{name}" for name in MEASURES], base_failed(F.col("m")).alias("base_failed"),
        _keeps(F.col("m"), F.col("condemned")).alias("kept"), F.col("condemned").alias("host_condemned"),
        F.round("rate", 6).alias("host_rate"))


def _keeps(m: Column, condemned: Column) -> Column:
    return ~base_failed(m) & ~(F.coalesce(condemned, F.lit(False)) & any_failed(m))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns unchanged.

    Null texts and sources, repeated rows and an empty table are treated as in ``judge``; columns of ``docs`` may have any
    names. Texts are measured twice, for the hosts and for the verdict: writing them with their measures in between
    halves the time but takes more memory than an executor has."""
    m, flag, rate, host = fresh(docs, "m", "condemned", "rate", "host")
    rows = measured(docs.select("text", F.col("source").alias(host)), m)
    verdicts = host_verdicts(rows.select(F.col(host).alias("host"), any_failed(F.col(m)).alias("failed")))
    joined = _with_verdicts(docs.withColumn(host, F.col("source")), host, verdicts, flag, rate)
    return measured(joined, m).filter(_keeps(F.col(m), F.col(flag))).select(docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT row_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT row_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id),
l AS (SELECT row_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT d.row_id, doc_id, source, len(words) AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM d JOIN w USING (row_id) JOIN l USING (row_id) LEFT JOIN covered USING (row_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM a GROUP BY source),
t AS (SELECT sum(bad) / sum(n) AS mean,
             (sum(bad::DOUBLE * bad / n) - sum(bad) * sum(bad) / sum(n) - (count(*) - 1) * (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)))
             / nullif(sum(n) - sum(n::DOUBLE * n) / sum(n), 0) AS between_hosts FROM h),
p AS (SELECT mean, CASE WHEN between_hosts > 0 THEN greatest(1.0, least(1e6, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS weight FROM t),
v AS (SELECT source, round((bad + mean * weight) / (n + weight), 6) AS host_rate,
        (bad + mean * weight) / (n + weight) > mean * (1 + 1e-9) AS condemned FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (condemned AND failed) AS kept, condemned AS host_condemned, host_rate
FROM a JOIN v ON a.source IS NOT DISTINCT FROM v.source
"""


@query("op6_quality_rules", ORACLE)
def op6(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
