"""Cross-site line deduplication, in DataFrame expressions only.

A line that stands on many distinct sites is boilerplate. Each site's lines are hashed; a HyperLogLog sketch of the
sites is kept for each line hash and merges by aggregation, so a line that stands in a third of all documents costs one
sketch a task. Sketches within `band` of the threshold are replaced by exact distinct counts. Of each boilerplate line
the first occurrence (smallest doc_id, then position) stays, so no passage is lost; all others are removed.

Lines are compared without surrounding white space. Blank lines are never boilerplate. Null or empty text stays as it is;
null site: one site named "". Repeated rows are treated alike: all rows with the first occurrence's doc_id and text keep the line.
Other columns pass through, whatever their names. No documents: an empty result. Very long texts: linear in the number of
lines. Texts travel through one shuffle if the table of affected documents is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.common import materialize, small_enough

MIN_SITES = 10
WS = " \t\r\x0b\x0c"


def line_keys(text):
    """An array of (hash, second hash) for each \\n-split line, null for blank ones. Two hashes: 96 bits in all."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS)))
    return F.transform(trimmed, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("a"), F.hash(x).alias("b"))))


def occurrences(docs: DataFrame, site_col: str) -> DataFrame:
    # the text is hashed below the explode, once for each document
    d = docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), line_keys(F.col("text")).alias("keys"))
    keyed = d.select("doc_id", "t", "site", F.posexplode_outer("keys").alias("pos", "key"))
    return keyed.where("key IS NOT NULL").select("doc_id", "t", "site", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b"))


def boilerplate_lines(lines: DataFrame, min_sites: int, band: float, lg_k: int) -> DataFrame:
    """a, b, doc_id, pos, t: the lines on at least min_sites sites, with their first occurrence."""
    spread = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos", "t")).alias("first"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    # a line with fewer occurrences than min_sites can't stand on min_sites sites
    spread = materialize(spread.where(F.col("n") >= min_sites).select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    near = spread.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("a", "b")
    near = F.broadcast(near) if small_enough(near, 32) else near
    exact = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("exact_sites"))
    decided = spread.join(exact, ["a", "b"], "left").where(F.coalesce(F.col("exact_sites"), F.col("sites")) >= min_sites)
    return materialize(decided.select("a", "b", "first.doc_id", "first.pos", "first.t"), "boilerplate")


def remove_boilerplate(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES, band: float = 0.2, lg_k: int = 12) -> DataFrame:
    """docs with boilerplate lines removed from text, and n_lines, n_removed.

    band: the share around min_sites within which a sketch isn't trusted; 2 ** lg_k registers a sketch give a relative
    standard error of about 1.04 / 2 ** (lg_k / 2), 1.6 % for 12, so a band of 0.2 is twelve standard errors wide.
    """
    bad = boilerplate_lines(occurrences(docs, site_col), min_sites, band, lg_k).withColumnsRenamed({"doc_id": "first_doc", "pos": "first_pos", "t": "first_t"})
    bad = F.broadcast(bad) if small_enough(bad, 64) else bad
    # only hashes travel to the join; it gives the positions to remove for each affected document
    gone = occurrences(docs, site_col).drop("site").join(bad, ["a", "b"]).where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos")) & (F.col("t") == F.col("first_t"))))
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("t").alias("_gone_t")).agg(F.collect_set("pos").alias("_gone"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_t") == F.col("_gone_t")), "left")
    # lines and the positions that stay are columns of their own, so that each is computed once; both are linear in the text
    rows = rows.select("_row", "_gone", F.split("_row.text", "\n").alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rows = rows.select("_row", "_gone", "_lines", F.when(F.col("_gone").isNotNull(), stay).alias("_stay"))
    left = F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(left).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in kept]
    return rows.select(*columns, F.coalesce(F.when(F.col("_row.text") == "", 0).otherwise(F.size("_lines")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
