"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

What holds for all stages: null, empty and blank texts, very long texts, repeated rows, tables without rows and further
columns of any name are allowed. Decisions are made from texts, and rows are told apart by doc_id and a 96-bit hash of the
text, null-safely, so rows without doc_id, or with one that others have too, are judged by their own text. Further columns
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.common import checked_join, materialize, scratch, table
from fluvial.llm import bpe, decontaminate, langid, line_dedup, minhash


def text_key() -> Column:
    """96 bits of the text, null for a null text."""
    return F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")))


def without(docs: DataFrame, gone: DataFrame, **columns: Column) -> DataFrame:
    """docs without the rows whose columns, null-safely, are a row of gone (the same columns)."""
    names = {c: f"_gone_{k}" for k, c in enumerate(columns)}
    marked = docs.select(F.struct(*docs.columns).alias("_row"), *[v.alias(c) for c, v in columns.items()])
    on = [F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()]
    left = checked_join(marked, gone.select(*[F.col(c).alias(name) for c, name in names.items()]), on, "left_anti", row_bytes=64)
    return left.select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes the recognised one.

    Texts without a letter, null ones included, are rejected. Repeated rows are judged alike. Without any labelled row no
    language is known, and every document goes.
    """
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    done = langid.identify(docs.select(*docs.columns), model).where(~F.col("rejected"))
    return done.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; a document of which nothing else is left goes; n_chars becomes that of the text.

    Null and empty texts stay as they are. Of equal first occurrences (rows with one doc_id and text) all keep the line.
    """
    done = line_dedup.remove_boilerplate(docs.withColumnsRenamed({c: f"_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}))
    done = done.where("NOT (coalesce(n_removed, 0) > 0 AND btrim(text, ' \t\n\r') = '')")
    own = {c: f"_{c}" if c in ("n_lines", "n_removed") else c for c in docs.columns}
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(own[c]).alias(c) for c in docs.columns])


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id.

    Rows without doc_id come last; of rows with one doc_id the one with the smallest hash of the text stays, and of rows
    that are also equal in text any one. Texts without words are no copies of anything.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    found = materialize(minhash.near_duplicates(docs.select(row.alias("doc_id"), "text"), k=5, percent=80).where("n_shingles > 0"), "copies")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("row")).distinct()
    twice = found.where("kept").groupBy(F.col("doc_id").alias("row")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")
    twice = materialize(twice, "equal-rows")
    left = without(docs, materialize(gone, "copies-gone"), row=row)
    if twice.isEmpty():
        return left
    marked = left.select(F.struct(*docs.columns).alias("_row"), row.alias("row"))
    again = checked_join(marked, twice, "row", "left_semi", row_bytes=64).dropDuplicates(["row"]).select("_row.*")
    return without(left, twice, row=row).unionByName(again)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A row goes if its own text holds one, whatever its doc_id. Null and empty texts, and all texts where the benchmark
    has no words, stay.
    """
    found = decontaminate.contamination(docs.select(text_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = materialize(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return without(docs, leaks, key=text_key())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and text as decoding the ids gives it back; a null text has no ids and becomes empty."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(docs, path, decoded="text")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", minhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL can't express language ID; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written besides its result is deleted when the stage is done."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
