"""Benchmark decontamination with a positional inverted index of the training documents.

build_index() inverts the documents where they lie: each task writes segments, one row each, of about SEGMENT_WORDS
words. A segment holds its documents, its distinct terms, and for each term the sorted positions at which it stands; the
documents of a segment follow one another in one space of positions. Nothing is shuffled, and a segment fits in memory.

search() cuts the test items into windows of consecutive words and orders the words of each window by how often the
whole index has them. In each segment it starts from the postings of a window's rarest word and intersects them,
adjusted by the words' offsets, with the next rarer word's, and so on. With slop 0 the result is each exact phrase; with
slop s each proximity match, in which every word stands at most s words from its place, in the same document.

Windows are made and counted in joins. The index is read once for the counts of words and once for the search: if the
windows have at most BLOCK_BYTES, which is counted, they are broadcast; otherwise each segment's words are joined with the
windows' rarest words, and each segment meets the windows it may hold in a cogroup, in as many parts of about BLOCK_BYTES
as its own windows need; segments that may hold none aren't moved. So the number of passes doesn't grow with the test items, and no item needs to fit anywhere but in its own text.

Null or empty texts have no words and never match. Repeated documents are indexed each; repeated items count once.
Null item_id: as the id "". No documents or no items: nothing matches. Very long texts are inverted whole; a segment is at least
one document. Of words of equal frequency the first in the window counts as the rarer. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.common import LARGE_ROWS, checked_join, materialize, small_batches, small_enough

SEGMENT_WORDS = 1 << 18
BLOCK_BYTES = 4 << 20
CANDIDATES = 1 << 21  # so many are looked at together
WINDOW = 10

#: A-Z to a-z; bytes that are no digit, letter or part of a character above U+007F to space.
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _segment(name: str, ids: list, words: list[list[bytes]]) -> dict:
    number = _Numbers()
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    flat = np.concatenate([np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in words] or [np.empty(0, np.int32)])
    order = np.argsort(flat, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(flat, minlength=len(number)))
    # differences between neighbours compress; one running sum gives the positions back
    return {"segment": name, "doc_ids": ids, "n_words": size, "starts": start, "terms": [w.decode("utf-8", "surrogatepass") for w in number], "ends": ends, "positions": np.diff(order, prepend=np.int32(0)).astype(np.int32).tobytes()}


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the index of docs (doc_id, text), written to the shared folder."""
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, made, ids, words, held = TaskContext.get().partitionId(), 0, [], [], 0
        schema = None

        def flush():
            row = _segment(f"{part}-{made}", ids, words)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            schema = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("n_words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("ends", pa.list_(pa.int64())), ("positions", pa.binary())])
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                words.append(words_of(text.as_py()))
                held += len(words[-1])
                if held >= segment_words:
                    yield flush()
                    made, ids, words, held = made + 1, [], [], 0
        if ids:
            yield flush()

    return materialize(d.mapInArrow(run, f"segment string, doc_ids array<{kind}>, n_words array<bigint>, starts array<bigint>, terms array<string>, ends array<bigint>, positions binary"), "positional-index", **LARGE_ROWS)


# -- windows of the test items -----------------------------------------------------------------------------------------

#: Windows that a task puts out at a time.
BATCH_WINDOWS = 10_000


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words) for each distinct window of consecutive words of the items, and (wid, item_id)."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = [x.decode("utf-8", "surrogatepass") for x in words_of(text)]
                places = range(max(1, len(w) - window + 1) if w else 0)
                for k in range(0, len(places), BATCH_WINDOWS):
                    part = [w[at : at + window] for at in places[k : k + BATCH_WINDOWS]]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.list_(pa.string()))], ["item_id", "words"])

    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    found = materialize(items.mapInArrow(cut, "item_id string, words array<string>").distinct(), "item-windows")
    words = materialize(found.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    return words, found.join(words, "words").select("wid", "item_id")


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often the index has each of the terms that it has."""
    few = small_enough(terms, 64)
    wanted = index.sparkSession.sparkContext.broadcast({r.term for r in terms.collect()} if few else None)  # counted: it is small

    def run(batches):
        only = wanted.value
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                names, n = terms.values.to_pylist(), np.diff(ends.values.to_numpy(), prepend=0)
                at = [k for k, t in enumerate(names) if only is None or t in only]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in at], pa.string()), pa.array(n[at], pa.int64())], ["term", "n"])

    found = index.select("terms", "ends").mapInArrow(run, "term string, n bigint")
    found = found if few else found.join(terms, "term", "left_semi")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def rarest_first(windows: DataFrame, index: DataFrame) -> DataFrame:
    """wid, terms (from the rarest in the index to the most frequent), offsets (where each stands); only of windows whose words
    the index has all."""
    terms = windows.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    counts = materialize(term_counts(index, materialize(terms.select("term").distinct(), "item-terms")), "term-counts")
    each = checked_join(terms, counts, "term", "inner", row_bytes=64)
    whole = each.groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("by")).where(F.size("by") == F.col("size"))
    return whole.select("wid", F.col("by.term").alias("terms"), F.col("by.offset").alias("offsets"))


class _Block:
    """Windows in the form in which a segment is searched for them."""

    def __init__(self, wid: list[int], terms: list[list[str]], offsets: list[list[int]]):
        number = _Numbers()
        self.wid, self.size = np.array(wid, np.int64), np.array([len(t) for t in terms], np.int64)
        longest = int(self.size.max(initial=0))
        self.word, self.offset = np.full((len(wid), longest), -1, np.int64), np.zeros((len(wid), longest), np.int64)
        for k, (t, o) in enumerate(zip(terms, offsets)):
            self.word[k, : len(t)], self.offset[k, : len(t)] = [number[x] for x in t], o
        self.vocabulary = dict(number)


def _hits(row: dict, block: _Block, slop: int):
    """(window, start) of each match in a segment."""
    where = np.full(len(block.vocabulary), -1, np.int64)
    for k, t in enumerate(row["terms"]):
        if (at := block.vocabulary.get(t)) is not None:
            where[at] = k
    position = np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int32).astype(np.int64)
    ends = row["ends"]
    begins = np.concatenate([[0], ends[:-1]])
    key = np.repeat(np.arange(len(ends)) << 32, np.diff(ends, prepend=0)) + position  # sorted
    doc_start, doc_end = row["starts"], row["starts"] + row["n_words"]
    local = np.where(block.word >= 0, where[block.word], 0)
    alive = np.flatnonzero((local >= 0).all(1))
    if not len(alive) or not len(key):
        return
    rarest = local[alive, 0]
    n = ends[rarest] - begins[rarest]
    group = np.cumsum(n) // CANDIDATES
    for g in np.unique(group):
        take, count = alive[group == g], n[group == g]
        window = np.repeat(take, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins[local[take, 0]], count)
        anchor = position[at]
        doc = np.searchsorted(doc_start, anchor, "right") - 1
        start = anchor - block.offset[window, 0]
        ok = (start + slop >= doc_start[doc]) & (start + block.size[window] - slop <= doc_end[doc])
        window, start, doc = window[ok], start[ok], doc[ok]
        for k in range(1, local.shape[1]):
            if not len(window):
                break
            place = start + block.offset[window, k]
            low, high = np.maximum(place - slop, doc_start[doc]), np.minimum(place + slop, doc_end[doc] - 1)
            base = local[window, k] << 32
            i = np.searchsorted(key, base + low)
            ok = (key[np.minimum(i, len(key) - 1)] <= base + high) & (i < len(key)) & (low <= high) | (k >= block.size[window])
            window, start, doc = window[ok], start[ok], doc[ok]
        yield window, start, doc


FOUND = "segment string, ord int, found array<struct<wid:bigint,start:bigint,end:bigint>>"


def _search_segment(segment: str, arrays: dict, block: _Block, slop: int) -> pa.RecordBatch:
    """A row for each document of the segment that has a window: its place and the windows found, with their words."""
    hits = [h for h in _hits(arrays, block, slop)] or [(np.empty(0, np.int64),) * 3]
    window, start, doc = (np.concatenate(x) for x in zip(*hits))
    start = start - arrays["starts"][doc]
    low, end = np.maximum(start - slop, 0), np.minimum(start + block.size[window] + slop, arrays["n_words"][doc])
    order = np.lexsort((low, doc))
    docs, first = np.unique(doc[order], return_index=True)
    rows = pa.StructArray.from_arrays([pa.array(block.wid[window[order]]), pa.array(low[order]), pa.array(end[order])], ["wid", "start", "end"])
    found = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), rows)
    return pa.RecordBatch.from_arrays([pa.array([segment] * len(docs), pa.string()), pa.array(docs, pa.int32()), found], ["segment", "ord", "found"])


_SEGMENT = ["segment", "n_words", "starts", "terms", "ends", "positions"]


def _arrays(table, k: int) -> tuple[str, dict]:
    row = {n: table.column(n)[k] for n in _SEGMENT}
    arrays = {n: row[n].values.to_numpy() for n in ("n_words", "starts", "ends")}
    return row["segment"].as_py(), arrays | {"terms": row["terms"].values.to_pylist(), "positions": row["positions"].as_py()}


def matches(index: DataFrame, ordered: DataFrame, slop: int = 0) -> DataFrame:
    """segment, ord, found: the windows (wid, start, end) in each document that has some; ord: its place in the segment. A document
    may have several rows. ordered: as rarest_first() has it."""
    ordered = materialize(ordered, "ordered-windows")
    weight = F.aggregate("terms", F.lit(32).cast("long"), lambda a, t: a + F.octet_length(t) + 24)
    size = ordered.agg(F.sum(weight)).first()[0] or 0
    if size <= BLOCK_BYTES:
        rows = ordered.collect()
        shared = index.sparkSession.sparkContext.broadcast(_Block([r.wid for r in rows], [r.terms for r in rows], [r.offsets for r in rows]))

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    yield _search_segment(*_arrays(batch, k), shared.value, slop)

        return index.select(*_SEGMENT).mapInArrow(run, FOUND)

    rare = ordered.select("wid", weight.alias("w"), F.get("terms", F.lit(0)).alias("term"))
    terms = index.select("segment", F.explode("terms").alias("term"))
    held = materialize(terms.join(rare, "term").select("segment", "wid", "w"), "segment-windows")
    parts = materialize(held.groupBy("segment").agg(F.ceil(F.sum("w") / BLOCK_BYTES).cast("bigint").alias("parts")), "segment-parts")
    held = checked_join(held.select("segment", "wid"), parts, "segment", "inner", row_bytes=64)
    held = held.select("segment", "wid", F.pmod("wid", "parts").alias("part")).join(ordered, "wid")
    # a segment travels as often as its own windows fill blocks; one that holds none of them stays where it is
    wanted = checked_join(index.select(*_SEGMENT), parts, "segment", "inner", row_bytes=64)
    segments = wanted.select(*_SEGMENT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))

    def meet(windows: pa.Table, segment: pa.Table) -> pa.Table:
        if not windows.num_rows or not segment.num_rows:
            return pa.Table.from_batches([_search_segment("", {"n_words": np.zeros(0, int), "starts": np.zeros(0, int), "ends": np.zeros(0, int), "terms": [], "positions": b""}, _Block([], [], []), slop)])
        segment = segment.combine_chunks()
        block = _Block(*(windows.column(c).to_pylist() for c in ("wid", "terms", "offsets")))
        return pa.Table.from_batches([_search_segment(*_arrays(segment, 0), block, slop)])

    return held.groupBy("segment", "part").cogroup(segments.groupBy("segment", "part")).applyInArrow(meet, FOUND)


def joined_spans(spans):
    """(start, end) spans, sorted, with those that meet or overlap made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(got, x):
        last = F.element_at(got, -1)
        return F.when(F.size(got) == 0, F.array(x)).when(x["start"] <= last["end"], F.concat(F.slice(got, F.lit(1), F.size(got) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))).otherwise(F.concat(got, F.array(x)))

    return F.aggregate(spans, empty, add)


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """segment, ord, doc_id, item_id, spans: for each document and item that match, the spans of words that do.

    items: item_id, text. spans: array of (start, end), in words, end exclusive.
    """
    windows, owners = item_windows(items, window)
    found = matches(index, rarest_first(windows, index), slop).select("segment", "ord", F.inline("found"))
    found = checked_join(found, materialize(owners, "owners"), "wid", "inner", row_bytes=64)
    found = found.groupBy("segment", "ord", "item_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"))
    ids = index.select("segment", F.posexplode("doc_ids").alias("ord", "doc_id"))
    return found.select("segment", "ord", "item_id", joined_spans("s").alias("spans")).join(ids, ["segment", "ord"]).select("segment", "ord", "doc_id", "item_id", "spans")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit (words inside a match), items (sorted ids), contaminated for each document."""
    index = build_index(docs, segment_words)
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("ord", "d")).select("segment", "ord", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    windows, owners = item_windows(items, window)
    found = materialize(matches(index, rarest_first(windows, index)), "phrase-matches")
    of = checked_join(found.select("segment", "ord", F.explode("found.wid").alias("wid")).distinct(), materialize(owners, "owners"), "wid", "inner", row_bytes=64)
    of = of.groupBy("segment", "ord").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    by_doc = found.groupBy("segment", "ord").agg(F.sort_array(spans).alias("s"))
    covered = F.aggregate(
        "s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")),
    )["n"]
    hits = materialize(by_doc.select("segment", "ord", covered.alias("n_hit")).join(of, ["segment", "ord"]), "contaminated")
    joined = every.join(hits, ["segment", "ord"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
