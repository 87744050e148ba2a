"""Importance resampling towards a target distribution, over hashed word n-grams.

count_matrix() turns texts into a sparse matrix of documents by buckets and persists it as blocks in compressed sparse rows (CSR):
one row of the table for each block of about BLOCK_TEXTS texts or BLOCK_BYTES bytes, with `indptr`, `indices` and `counts` as little-endian integers.
Features are all runs of one or two consecutive words, a feature's bucket is the CRC-32 of its bytes modulo the number of buckets.
The CRC of a pair is composed of those of its words (CRC is linear), so each distinct word is hashed once a block.

Column sums of the blocks, one vector of `buckets` numbers a task, give the distribution of corpus and target; the matrix times the vector
of the buckets' gains (log ratios of both, smoothed by one, in thousandths) gives each document's weight. With Gumbel noise from a hash of
the id, the highest scores are a sample without replacement in proportion to exp(weight / 1000).

Only the vectors of `buckets` numbers and counts of rows reach the driver. Ranks come from a range-partitioned sort of ids and scores.

Null or empty text: no words, weight 0. Very long texts are read whole; a row of the matrix has at most `buckets` entries. Null doc_id: as
an empty id in the noise, before all others among ties. Repeated rows count each; rows equal in score and id are ranked in the order of their
place in the persisted matrix. No documents: an empty result; no target: T = 0. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.common import LARGE_ROWS, materialize, numbered, small_batches
from fluvial.llm.decontaminate import words_of

BUCKETS = 10_000
BLOCK_TEXTS, BLOCK_BYTES = 1000, 4 << 20


def crc_shift(length: int) -> np.ndarray:
    """Four tables of 256 numbers: what `length` further bytes, apart from their own CRC, make of each byte of a CRC-32."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    bits = [zlib.crc32(zeros, 1 << k) ^ base for k in range(32)]
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(bits[8 * byte + bit])
    return out


def pair_crcs(first: np.ndarray, second: np.ndarray, crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of "first second" for arrays of word numbers. crc, tail: of each word, and of it behind a space; size: its bytes and one."""
    sizes, of = np.unique(size, return_inverse=True)
    tables = np.stack([crc_shift(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)
    head, kind = crc[first], of[second]
    out = tail[second]
    for byte in range(4):
        out = out ^ tables[kind, byte, (head >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def bucket_counts(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_words, indptr, indices, counts of the texts' rows."""
    words = [words_of(t) for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), np.int64, int(size.sum()))
    del words
    crc = np.fromiter(map(zlib.crc32, number), np.uint32, len(number))
    tail = np.fromiter((zlib.crc32(b" " + w) for w in number), np.uint32, len(number))
    length = np.fromiter((len(w) + 1 for w in number), np.int64, len(number))
    row = np.repeat(np.arange(len(texts)), size)
    inside = row[1:] == row[:-1]
    first, second = flat[:-1][inside], flat[1:][inside]
    bucket = np.concatenate([crc[flat], pair_crcs(first, second, crc, tail, length)]) % np.uint32(buckets)
    key = np.concatenate([row, row[1:][inside]]) * buckets + bucket
    key, counts = np.unique(key, return_counts=True)
    return size, np.searchsorted(key, np.arange(len(texts) + 1) * buckets), key % buckets, counts


def _dtype(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def count_matrix(docs: DataFrame, buckets: int = BUCKETS, name: str = "count-matrix") -> DataFrame:
    """The CSR blocks of docs (doc_id, text), written to the shared folder: block (partition and number in it), doc_ids, n_words, indptr (from 0, one more
    than documents, 8 bytes each), indices (2 bytes each, or 4 for more than 65,536 buckets), counts (4 bytes each)."""
    small_batches(docs.sparkSession, BLOCK_TEXTS, BLOCK_BYTES)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    dtype = _dtype(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not len(batch):
                continue
            n, indptr, indices, counts = bucket_counts(batch.column(1).to_pylist(), buckets)
            cols = [
                pa.array([(part << 32) + made], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([n.tolist()], pa.list_(pa.int64())),
                *(pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((indptr, "<i8"), (indices, dtype), (counts, "<u4"))),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "n_words", "indptr", "indices", "counts"])
            made += 1

    return materialize(d.mapInArrow(run, f"block bigint, doc_ids array<{kind}>, n_words array<bigint>, indptr binary, indices binary, counts binary"), name, **LARGE_ROWS)


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has. At most `buckets` rows leave a task."""
    dtype = _dtype(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, counts in zip(batch.column(0), batch.column(1)):
                # each product of sums stays below 2 ** 53, so float weights lose nothing
                total += np.bincount(np.frombuffer(indices.as_buffer(), dtype), np.frombuffer(counts.as_buffer(), "<u4"), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    sums = matrix.select("indices", "counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed distributions, rounded down."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target)], np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(matrix: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and block and row, the document's place in the matrix."""
    dtype = _dtype(len(gain))
    shared = matrix.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain = shared.value
        for batch in batches:
            for k in range(len(batch)):
                block, ids, n, indptr, indices, counts = (c[k] for c in batch.columns)
                n = np.array(n.as_py(), np.int64)
                features = np.maximum(2 * n - 1, 0)
                product = gain[np.frombuffer(indices.as_buffer(), dtype)] * np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                upto = np.concatenate([[0], np.cumsum(product)])[np.frombuffer(indptr.as_buffer(), "<i8")]
                weight = np.where(features > 0, np.diff(upto) // np.maximum(features, 1), 0)
                score = weight + np.fromiter((noise(x, seed) for x in ids.as_py()), np.int64, len(n))
                cols = [ids.values, pa.array(n), pa.array(features), pa.array(weight), pa.array(score), pa.array(np.full(len(n), block.as_py())), pa.array(np.arange(len(n)))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight", "score", "block", "row"])

    kind = matrix.schema["doc_ids"].dataType.elementType.simpleString()
    return matrix.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, block bigint, row bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each document.

    target: texts of the wished distribution, in its column text. Of the N documents with at least min_words words, the floor(percent * N / 100)
    with the highest scores are drawn, ties to the smaller doc_id, and ranked from 1; all others have no rank.
    """
    matrix = count_matrix(docs, buckets)
    wished = count_matrix(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), buckets, "target-matrix")
    gain = gains(column_sums(matrix, buckets), column_sums(wished, buckets))
    scored = weights(matrix, gain, seed).withColumn("_out", F.col("n_words") < min_words)
    # the pool comes first, so a place in this order below the number of draws is a rank
    placed = numbered(scored, ["_out", F.desc("score"), F.asc_nulls_first("doc_id"), "block", "row"], "_place")
    drawn = placed.where("NOT _out").agg(F.count(F.lit(1)).alias("n")).first().n * percent // 100
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_place") < drawn, F.col("_place") + 1).alias("rank"))
