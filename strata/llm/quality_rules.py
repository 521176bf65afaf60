"""Quality rules with host verdicts (operator 10), DataFrame functions only.

Per document the rules count words and repetitions; per host the failures are
aggregated (partial aggregation, so a host with a third of all rows is one row
per task), the failure rate is shrunk towards an empirical beta prior, and the
host's verdict is joined back.

The prior is fitted by moments: its mean is the corpus rate m, and its variance what
the hosts' rates vary by beyond the noise of counting.  A host fails when its shrunk
rate is above the prior's mean by ``SIGMAS`` of the prior's deviations, or above one
half (above m, if that is more) where the prior is so wide that this comes first: few
hosts then tell what is usual, and a host most of whose documents fail is no source.

Defined results: a null text counts as having no words; a null host is a host of
its own; repeated rows are judged one by one; a rate that equals the bar passes; a
corpus of one host has nothing to compare and its host passes unless most of it fails;
texts are read whole; an empty table gives an empty result.  Columns of the input whose
names clash with a result column are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import digest, free, without

#: fixed values: the contract's white space and symbols
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: a host goes when its shrunk failure rate is so many of the prior's deviations above the prior's mean
SIGMAS = 3.0
#: prior weight, in documents, is kept within these bounds
PRIOR_WEIGHT = (2.0, 1000.0)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """Bind ``value`` once: a lambda variable is never computed again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, overlaps counted once."""

    def exact(ws: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.concat_ws(" ", ws[i], ws[i + 1], ws[i + 2]).alias("w"), i.alias("i")))
        return _let(F.array_sort(windows), lambda s: _let(F.size(s), lambda n: _let(twice(s, n), covered)))

    def twice(s: Column, n: Column) -> Column:
        same = lambda x, j: s[j]["w"] == x["w"]
        hit = F.filter(s, lambda x, k: ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | ((k < n - 1) & same(x, F.least(k + 1, n - 1))))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("sum"), i.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["sum"])

    def looked_at(ws: Column) -> Column:
        hashes = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(ws[i], ws[i + 1], ws[i + 2])))
        # equal windows have equal hashes, so most texts need no sort of the windows themselves
        some = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(some, exact(ws)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(words, looked_at))


def count_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts and ``base_failed``; no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    spaced = F.translate(body, WHITE, " " * len(WHITE))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    counts = _let(
        words,
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
            _repeat_words(ws).alias("n_repeat_words"),
        ),
    )
    kept, c = [x for x in docs.columns if x.lower() not in (*COUNTS, "base_failed", "kept")], free(docs, "_c")
    out = docs.withColumn(c, counts)
    out = out.select(
        *[F.col(f"`{x}`") for x in kept],
        F.col(f"{c}.n_words").alias("n_words"),
        F.col(f"{c}.word_chars").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col(f"{c}.n_repeat_words").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(judged: DataFrame, host: str = "source", sigmas: float = SIGMAS) -> DataFrame:
    """One row per host: n, failed, shrunk rate, the bar and ``host_failed``.

    Hosts with few documents are drawn to the corpus rate.
    """
    hosts = judged.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    m, total = F.col("m"), F.col("total")
    moments = hosts.agg((F.sum("failed") / F.sum("n")).alias("m"), (F.sum(F.col("n") * rate * rate) / F.sum("n")).alias("m2"), F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("total"))
    noise = m * (1 - m) * (F.col("hosts") - 1) / total
    spread = F.greatest(F.col("m2") - m * m - noise, F.lit(1e-12))
    moments = moments.withColumn("weight", F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1])))
    bar = F.least(m + sigmas * F.sqrt(m * (1 - m) / (F.col("weight") + 1)), F.greatest(m, F.lit(0.5)))
    prior = moments.select(F.struct(m, F.col("weight"), bar.alias("bar")).alias("prior")).scalar()
    shrunk = hosts.withColumn("prior", prior).withColumn("rate", (F.col("failed") + F.col("prior.m") * F.col("prior.weight")) / (F.col("n") + F.col("prior.weight")))
    return shrunk.select("host", "n", "failed", "rate", F.col("prior.bar").alias("bar"), (F.col("rate") > F.col("prior.bar")).alias("host_failed"))


def with_verdicts(judged: DataFrame, host: str = "source", sigmas: float = SIGMAS) -> DataFrame:
    """Add ``kept``, false where a document or its host failed."""
    name, verdict = free(judged, "_host"), free(judged, "_host_failed")
    hosts = host_verdicts(judged, host, sigmas).select(F.col("host").alias(name), F.col("host_failed").alias(verdict))
    joined = judged.join(hosts, F.col(f"`{host}`").eqNullSafe(F.col(name)), "left")
    return joined.withColumn("kept", ~(F.col("base_failed") | F.coalesce(F.col(verdict), F.lit(False)))).drop(name, verdict)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", sigmas: float = SIGMAS) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns.

    The rules run once, over narrow rows; ``docs`` must give the same rows in the same
    order each time, as a file scan does, and is found out if it does not.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{host}`").alias("source"), F.col(f"`{text}`").alias("text"))
    judged = count_rules(rows).select("rid", "digest", "source", "base_failed").checkpoint()
    return without(docs, with_verdicts(judged, "source", sigmas).filter(~F.col("kept")).select("rid", "digest"), text)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    judged = count_rules(docs).drop("text").checkpoint()
    return with_verdicts(judged).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'g': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]})) AS x FROM w WHERE len(ws) > 2),
rep AS (SELECT rid, x.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x.g) > 1),
cov AS (SELECT rid, sum(least(3, i - coalesce(prev, -3)))::BIGINT AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM rep) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT rid, (count(*) - count(DISTINCT l))::BIGINT AS n FROM lines WHERE regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> '' GROUP BY rid),
c AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
m AS (SELECT sum(f) / sum(n) AS m, sum(n * (f / n) * (f / n)) / sum(n) AS m2, count(*) AS hosts, sum(n) AS total FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest(m2 - m * m - m * (1 - m) * (hosts - 1) / total, 1e-12) - 1, 2.0), 1000.0) AS k FROM m),
v AS (SELECT source, (f + m * k) / (n + k) > least(m + 3 * sqrt(m * (1 - m) / (k + 1)), greatest(m, 0.5)) AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR coalesce(host_failed, false)) AS kept
FROM b LEFT JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
