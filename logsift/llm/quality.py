"""Quality rules by host: failures of document rules are counted by host, shrunk with an empirical
beta prior, and the hosts' verdicts are joined back to their documents. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Hosts up to this many are broadcast (some tens of bytes each); beyond it the join is salted.
BROADCAST_HOSTS = 50_000
SALTS = 32
RULES = {
    "short": "n_words < 20",
    "repeat": "100 * n_repeat_words > 30 * n_words",
    "symbol": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
BASE_RULES = ("short", "repeat")


def _repeat_words(hashes: Column, width: int) -> Column:
    """Words in windows whose hash stands twice or more in the array of a text's window hashes."""
    pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("v"), i.alias("i")))

    def starts(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["v"] == e["v"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        step = lambda k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(width)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + step(k))

    # arrays of one element bind a value once for the functions inside
    found = F.transform(F.array(F.sort_array(pairs)), starts)
    return F.transform(found, covered)[0]


def rule_features(docs: DataFrame, width: int = 8) -> DataFrame:
    """doc_id, source and the counts that the rules use, of every whole text (null: none of anything)."""
    text = F.coalesce(docs["text"], F.lit(""))
    one = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), text.alias("_t"), words_of(docs["text"]).alias("_w"))
    n = F.size("_w")
    at = F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(F.array().cast("array<int>"))
    two = one.select(
        "doc_id", "source", n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_l"),
        F.transform(at, lambda i: F.xxhash64(F.slice("_w", i, width))).alias("_h"),
    )
    return two.select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_h"), width)).alias("n_repeat_words"),
    )


def host_verdicts(features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source, n_docs, a shrunk failure rate for each rule, and host_failed: some rate is above the threshold.

    The prior of a rule is the beta distribution with the mean and the variance of the hosts' own rates
    (method of moments); its weight is held between 1 and a million documents. Null is a host too.
    """
    fails = [F.sum(F.expr(rule).cast("long")).alias(f"f_{k}") for k, rule in RULES.items()]
    hosts = features.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *fails)
    rates = lambda k: F.col(f"f_{k}") / F.col("n_docs")
    prior = hosts.agg(*(x for k in RULES for x in (F.avg(rates(k)).alias(f"m_{k}"), F.var_pop(rates(k)).alias(f"v_{k}"))))
    joined = hosts.join(F.broadcast(prior))  # one row

    def shrunk(k: str) -> Column:
        m, v = F.col(f"m_{k}"), F.col(f"v_{k}")
        weight = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / v - 1))).otherwise(F.lit(1e6))
        return (F.col(f"f_{k}") + m * weight) / (F.col("n_docs") + weight)

    out = joined.select("source", "n_docs", *(shrunk(k).alias(f"rate_{k}") for k in RULES))
    return out.withColumn("host_failed", F.greatest(*(F.col(f"rate_{k}") for k in RULES)) > threshold)


def host_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Document counts, base_failed, host_failed and kept, one row for each row of docs (doc_id, text, source).

    A document that fails a base rule (under 20 words, or over 30 % of its words in repeated windows of eight)
    isn't kept; any other takes its host's verdict. Null or empty text: no words, so base_failed. Null source:
    one host of its own. Rows that repeat a doc_id are judged each on its own. No rows: no rows.
    """
    features = materialize(rule_features(docs))
    verdicts = materialize(host_verdicts(features, threshold).select(F.col("source").alias("_host"), "host_failed"))
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = features.join(F.broadcast(verdicts), F.col("source").eqNullSafe(F.col("_host")), "left")
    else:
        salted = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = features.withColumn("_s", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
        joined = left.join(salted, F.col("source").eqNullSafe(F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    base = F.expr(" or ".join(RULES[k] for k in BASE_RULES))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~F.coalesce("host_failed", F.lit(False))).alias("kept"), F.coalesce("host_failed", F.lit(False)).alias("host_failed"),
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return host_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+7], chr(10)) AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n_repeat_words
      FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM c) GROUP BY r),
f AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
x AS (SELECT *, n_words < 20 AS a, 100 * n_repeat_words > 30 * n_words AS b, 10 * n_symbols > n_words AS c,
             100 * n_dup_lines > 30 * n_lines AS d, (word_chars < 3 * n_words OR word_chars > 10 * n_words) AS e FROM f),
h AS (SELECT source, unnest(['a', 'b', 'c', 'd', 'e']) AS rule, count(*) AS n,
             unnest([sum(a::INT), sum(b::INT), sum(c::INT), sum(d::INT), sum(e::INT)]) AS k FROM x GROUP BY source),
m AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS z FROM m),
y AS (SELECT source, max((k + m * z) / (n + z)) > 0.5 AS host_failed FROM h JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (a OR b) AS base_failed,
       (NOT (a OR b) AND NOT host_failed) AS kept, host_failed
FROM x JOIN y ON x.source IS NOT DISTINCT FROM y.source
"""
