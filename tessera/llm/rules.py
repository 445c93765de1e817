"""Quality rules with host verdicts (operator 5), DataFrame functions only.

Method: host-level rules. Base rules judge each document; failures are summed by host (``source``); host
rates are shrunk with a beta prior fitted to all hosts by the method of moments; a host whose shrunk rate is
above ``HOST_LIMIT`` is rejected, and its verdict joined back to its documents.

Scale: the only exchange before the join is one row per host and task (partial sums). Documents reach the
join as their counts alone, without texts. Hosts are broadcast only when they are at most
``BROADCAST_HOSTS``, which is counted; beyond, it is a shuffled join whose hot hosts AQE splits.

Cases: a null or empty text has no words and fails; all-null hosts form one host of their own; repeated rows
count as rows; an empty table gives an empty result; only the columns named are read, so clashing names in
other columns are of no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, bounded, durable, stored, text_or_empty

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
HOST_LIMIT = 0.5
BROADCAST_HOSTS = 100_000
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once as a lambda variable; an inlined expression would be evaluated per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in five-word windows found twice or more, the first occurrence included."""

    def covered(places: Column) -> Column:
        # places: ascending starts of repeated windows; each covers up to the next start, five words at most
        return F.aggregate(
            places,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
            lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")),
            lambda a: a["sum"],
        )

    def repeated(keys: Column) -> Column:
        ranked = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return _let(
            ranked,
            lambda s: covered(
                F.array_sort(
                    F.transform(
                        F.filter(
                            F.transform(
                                s,
                                lambda x, i: F.struct(
                                    x["i"].alias("i"),
                                    (
                                        (F.get(s, i - 1)["k"].eqNullSafe(x["k"]))
                                        | (F.get(s, i + 1)["k"].eqNullSafe(x["k"]))
                                    ).alias("twice"),
                                ),
                            ),
                            lambda x: x["twice"],
                        ),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        )

    def count(hashes: Column) -> Column:
        return _let(
            windows(hashes),
            lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(repeated(keys)),
        )

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), count)
    )


def base_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the rule counts of each text appended."""
    text = text_or_empty(text_column)
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return (
        docs.withColumn("n_words", _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))))
        .withColumn("n_repeat_words", F.col("n_words.r").cast("long"))
        .withColumn("n_words", F.col("n_words.n").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, SPACE, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        )
    )


def host_verdicts(counted: DataFrame, host: str = "source", failed: str = "base_failed") -> DataFrame:
    """host, n, n_failed, rate (shrunk) and rejected, one row per host."""
    hosts = counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed")
    )
    hosts = durable(hosts)
    p = F.col("n_failed") / F.col("n")
    moments = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("rows"),
        F.sum("n_failed").alias("fails"),
        F.sum(F.col("n") * p * p).alias("squares"),
    )
    mean = F.try_divide(F.col("fails"), F.col("rows"))
    spread = F.try_divide(F.col("squares"), F.col("rows")) - mean * mean
    noise = F.try_divide(mean * (1 - mean) * F.col("hosts"), F.col("rows"))
    between = F.greatest(spread - noise, mean * (1 - mean) * F.lit(1e-6))
    strength = F.greatest(F.lit(2.0), F.least(F.lit(1e6), F.coalesce(F.try_divide(mean * (1 - mean), between), F.lit(0.0)) - 1))
    alpha, beta = moments.select(
        F.coalesce(mean * F.coalesce(strength, F.lit(2.0)), F.lit(1.0)),
        F.coalesce((1 - mean) * F.coalesce(strength, F.lit(2.0)), F.lit(1.0)),
    ).first()  # two numbers
    shrunk = hosts.withColumn("rate", (F.col("n_failed") + alpha) / (F.col("n") + (alpha + beta)))
    return shrunk.select("host", "n", "n_failed", "rate", (F.col("rate") > HOST_LIMIT).alias("rejected"))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = base_counts(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            F.col(text_column).alias("text"),
            F.col(host_column).alias("source"),
        )
    )
    counted = durable(counted.drop("text"))
    rejected = host_verdicts(counted).where("rejected").select("host", "rejected")
    return (
        counted.join(bounded(rejected, BROADCAST_HOSTS), F.col("source").eqNullSafe(F.col("host")), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("rejected").isNull())
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
        )
    )


def keep_documents(docs: DataFrame, text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor their host's verdict reject, columns unchanged.

    The counts are taken once: rows are written with the base rules' verdict, hosts are summed from that column
    alone, and what is kept is read back with the verdict pushed down to the scan. Texts are not shuffled.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    counted = base_counts(rows.select("row", F.col(f"row.`{text_column}`").alias("text")))
    judged = stored(counted.select("row", F.col(f"row.`{host_column}`").alias("source"), "base_failed"))
    rejected = host_verdicts(judged).where("rejected").select("host")
    return (
        judged.where(~F.col("base_failed"))
        .join(bounded(rejected, BROADCAST_HOSTS), F.col("source").eqNullSafe(F.col("host")), "left_anti")
        .select("row.*")
    )


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, source, text,
    list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM d),
g AS (
  SELECT rid, i AS place, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (
  SELECT rid, place FROM (SELECT rid, place, count(*) OVER (PARTITION BY rid, win) AS times FROM g) WHERE times > 1),
c AS (
  SELECT rid, count(DISTINCT place + k) AS n_repeat_words FROM r, range(0, 5) AS o(k) GROUP BY rid),
b AS (
  SELECT w.rid, doc_id, source, len(words) AS n_words,
    length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.rid = c.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS x FROM f GROUP BY source),
m AS (SELECT count(*) AS hosts, sum(n) AS rws, sum(x) / sum(n) AS mean, sum(n * (x / n) * (x / n)) / sum(n) AS sq FROM h),
s AS (SELECT mean, greatest(2.0, least(1e6, mean * (1 - mean)
    / nullif(greatest(sq - mean * mean - mean * (1 - mean) * hosts / rws, mean * (1 - mean) * 1e-6), 0) - 1)) AS st FROM m),
v AS (SELECT source, (x + mean * coalesce(st, 2.0)) / (n + coalesce(st, 2.0)) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
