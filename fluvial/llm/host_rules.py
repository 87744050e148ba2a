"""Quality rules with host-level verdicts, in DataFrame expressions only.

Each document is measured by itself; failures are then counted by host, each host's failure rate is shrunk towards the
rate of all hosts with an empirical beta prior, and the verdict on the host is joined back to its documents.

Null or empty text: no words, so base_failed. Null host: one host named "". No documents: an empty result. Repeated
rows are measured and counted each. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.common import checked_join, materialize

SPACE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def document_metrics(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("t"))
    d = d.select(
        "doc_id", "host", "t",
        F.array_remove(F.split(F.translate("t", SPACE, " " * len(SPACE)), " "), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.translate(x, " " + SPACE, "") != "").alias("lines"),
    )
    d = d.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", " " + SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    base = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # a hash for each window of five words; each array is a column of its own, so that it is computed once
    d = d.select(*base, F.when(F.size("h") >= WINDOW, F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>")).alias("w"))
    d = d.select(*base, F.when(F.size(F.array_distinct("w")) < F.size("w"), F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>")).alias("s"))
    d = d.select(*base, F.sort_array(F.transform(F.filter("s", lambda e, i: (e["x"] == F.get("s", i - 1)["x"]) | (e["x"] == F.get("s", i + 1)["x"])), lambda e: e["i"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    d = d.select(*base, covered.cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(metrics: DataFrame, max_rate: float) -> DataFrame:
    """host, host_docs, host_rate (shrunk failure rate), host_failed.

    The prior's two parameters are matched to mean and variance of the hosts' raw rates; a host with few documents is
    judged by the prior, one with many by its own rate. Without spread between hosts the prior weighs MAX_PRIOR
    documents.
    """
    hosts = metrics.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    weight, mean = prior_weight(prior.m, prior.v), prior.m or 0.0
    shrunk = (F.col("f") + weight * mean) / (F.col("n") + weight)
    return hosts.select("host", F.col("n").alias("host_docs"), shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_failed"))


MAX_PRIOR = 1000.0


def prior_weight(mean: float | None, var: float | None) -> float:
    if not mean or mean >= 1 or not var:
        return MAX_PRIOR
    return min(MAX_PRIOR, max(1.0, mean * (1 - mean) / var - 1))


def apply_rules(docs: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Metrics, host verdict and kept for each document. max_rate: hosts whose shrunk failure rate is above it go."""
    metrics = materialize(document_metrics(docs, host_col), "host-rules")  # read twice; a few dozen bytes a document
    verdicts = host_verdicts(metrics, max_rate)
    joined = checked_join(metrics, verdicts, "host", "left", row_bytes=200)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
