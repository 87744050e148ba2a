"""WARC archives with a two-level capture index.

write_archives() writes a record for each page, whole, uncompressed, as plain .txt-named WARC/1.1 files: Spark's text
writer puts out header, HTTP header and payload, and its line separator is the two line ends that close a record.
Records with equal payloads become revisits of the one with the smallest page_id.

build_index() scans the archives in a stream, record by record, sorts the captures by reversed-host URL key, compresses
them in blocks of BLOCK_LINES lines, and keeps a sparse directory of each block's first and last key, in pages, of which a
root has the first key: ROOT_PAGES of KEY_CHARS characters at most, whatever the size of the index. lookup() searches the
root by bisection, then the pages, then the blocks; keys meet pages and blocks in joins by number. Only then fetch() reads
the byte ranges of the records found, in as many tasks as their bytes need.

Files are opened by pyarrow, where it knows the scheme, and ranges are read from them. For all other schemes Spark reads
the files, one by one, and ranges are cut from them in memory.

A page_id may be any value that casts to text and back; in headers and index it is percent-encoded.

Null html: an empty payload. Null url: the key "". Null page_id: a record without Page-Id; it never is the one that
others revisit unless all of its copies lack an id, and then all are responses. Rows with equal page_id and payload are
all responses if that page_id is the smallest. No pages: no records. Very long payloads are written and read whole. Other
columns are ignored, whatever their names. Memory: a record, a block, a page of the directory.
"""

from __future__ import annotations

import base64
import bisect
import contextlib
import hashlib
import math
import re
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.common import materialize, shared_path, skew_join, small_enough

BLOCK_LINES = 512
PAGE_BLOCKS = 64
ROOT_PAGES, KEY_CHARS = 1 << 16, 256
READ = 1 << 20
#: Bytes of records that a task of fetch() reads.
PART_BYTES = 32 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id string, record_type string, digest string, path string, offset bigint, length bigint"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four characters."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: What a header line or a line of the index can't hold as it is, or loses at its ends.
ESCAPES = {"%": "%25", "\t": "%09", "\n": "%0A", "\r": "%0D", " ": "%20"}


def escaped(page_id: Column) -> Column:
    """Any text as a value of a header: percent signs, tabs, line ends and spaces are percent-encoded."""
    out = page_id.cast("string")
    for c, code in ESCAPES.items():  # the percent sign comes first
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def unescaped(value: str | None) -> str | None:
    plain = {code: c for c, code in ESCAPES.items()}
    return value if value is None else re.sub("%(?:25|09|0A|0D|20)", lambda m: plain[m[0]], value)


def url_key(url: str) -> str:
    """Reversed host, path and query: com,example)/a?b=1. Scheme, user, port, a leading www. and the fragment go."""
    url = re.sub(r"[\r\n]", "", url).strip()  # as the archive has it
    try:
        p = urlsplit(url)
        host = (p.hostname or "").lower().removeprefix("www.")
    except ValueError:
        return url
    if not host:
        return url
    return f"{','.join(reversed(host.split('.')))}){(p.path or '/').lower()}{'?' + p.query if p.query else ''}"


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", payload.alias("payload"))
    p = p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("payload_digest"))
    copies = p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    copies = materialize(copies.where("n > 1"), "warc-copies")
    if small_enough(copies, 100):
        p = p.join(F.broadcast(copies.drop("n")), "payload_digest", "left")
    else:
        p = skew_join(p, copies, "payload_digest", "n", pages.count())
    return p.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def record(date: str) -> Column:
    """A record, but for the two line ends that close it, from the columns of classify()."""
    name = lambda page_id, digest: F.concat(F.lit("<urn:sha1:"), digest, F.lit(":"), escaped(page_id), F.lit(">"))
    page_id, digest = F.col("page_id"), F.col("payload_digest")
    revisit = F.col("refers_to").isNotNull()
    line = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(F.coalesce(page_id.cast("string"), F.lit("")), digest)),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("Page-Id", escaped(page_id)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("refers_to"), digest)), line("Refers-To-Page-Id", escaped(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"), http, F.when(revisit, "").otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 10_000) -> None:
    classify(pages, min_bytes).select(record(date).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _file_system(path: str):
    """pyarrow's file system for a path as Spark has it, and the path in it."""
    path = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path))
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)


def reads_ranges(path: str) -> bool:
    """Whether pyarrow can open files there."""
    try:
        _file_system(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


class _Held:
    """A file in memory."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, at: int) -> bytes:
        return bytes(self.data[at : at + n])

    def close(self) -> None:
        pass


def _open(path: str, data: bytes | None = None):
    if data is not None:
        return _Held(data)
    fs, inside = _file_system(path)
    return fs.open_input_file(inside)


def header_fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip(" \t")
    return out


def scan_archive(path: str, data: bytes | None = None):
    """(offset, length, fields) of each record of a file, read in pieces of READ bytes; blocks are skipped over."""
    with contextlib.closing(_open(path, data)) as f:
        size, at, held, start = f.size(), 0, b"", 0
        while at < size:
            if start > at or at >= start + len(held):
                start, held = at, f.read_at(READ, at)
            while (end := held.find(END.encode(), at - start)) < 0:
                more = f.read_at(READ, start + len(held))
                if not more:
                    raise ValueError(f"{path}: no header at {at}")
                held = held[at - start :] + more
                start = at
            fields = header_fields(held[at - start : end])
            length = end + start + 4 + int(fields["content-length"]) - at
            yield at, length, fields
            at += length + 4


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content, null where ranges of the file can be read."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path", F.lit(None).cast("binary").alias("content")) if reads_ranges(path) else files.select("path", "content")


def build_index(spark: SparkSession, archives: str, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Blocks under path/blocks, the directory under path/directory, its root under path/root."""

    def scan(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, length, x in scan_archive(file, data.as_py()):
                    rows.append((_plain(url_key(x.get("warc-target-uri", ""))), x.get("page-id", ""), x["warc-type"], x["warc-payload-digest"], file, offset, length))
                    if len(rows) == 5000:
                        yield _captures(rows)
                        rows = []
                yield _captures(rows)

    def pack(batches):
        lines = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(row)
                if len(lines) == block_lines:
                    yield _block(lines)
                    lines = []
        if lines:
            yield _block(lines)

    captures = materialize(archive_files(spark, archives).mapInArrow(scan, CAPTURE), "warc-captures")
    n = min(ROOT_PAGES, max(1, captures.count() // (PAGE_BLOCKS * block_lines)))
    order = ["key", "page_id", "path", "offset"]
    blocks = captures.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pack, "first_key string, last_key string, n bigint, data binary")
    # a page of the directory is what one task has packed
    blocks.select(F.spark_partition_id().alias("page"), F.monotonically_increasing_id().alias("block"), "*").write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").select("page", "block", "first_key", "last_key", "n").write.parquet(f"{path}/directory")
    root = spark.read.parquet(f"{path}/directory").groupBy("page").agg(F.substring(F.min("first_key"), 1, KEY_CHARS).alias("first_key"))
    root.write.parquet(f"{path}/root")


def _captures(rows: list) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["key", "page_id", "record_type", "digest", "path", "offset", "length"])


def _block(lines: list) -> pa.RecordBatch:
    data = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode("utf-8", "surrogatepass"))
    return pa.RecordBatch.from_arrays([pa.array([lines[0][0]]), pa.array([lines[-1][0]]), pa.array([len(lines)]), pa.array([data], pa.binary())], ["first_key", "last_key", "n", "data"])


def _plain(key: str) -> str:
    return key.replace("\t", "%09").replace("\n", "%0A")


def _unpack(data: bytes) -> list[tuple]:
    rows = (line.split("\t") for line in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n"))
    return [(r[0], unescaped(r[1]), *r[2:5], int(r[5]), int(r[6])) for r in rows]


def lookup(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame:
    """The captures of urls (one column, url), each once: root, directory and blocks are searched by bisection.

    Keys are joined with the pages of the directory, and then with the blocks, that may have them; a block is unpacked once.
    """
    root = sorted((r.first_key, r.page) for r in spark.read.parquet(f"{index}/root").collect())  # ROOT_PAGES rows at most
    shared = spark.sparkContext.broadcast(([k for k, _ in root], [p for _, p in root]))

    def to_pages(batches):
        firsts, pages = shared.value
        for batch in batches:
            keys = sorted({_plain(url_key(u or "")) for u in batch.column(0).to_pylist()})
            rows = []
            for k in keys:
                short = k[:KEY_CHARS]
                low, high = bisect.bisect_left(firsts, short), bisect.bisect_right(firsts, short)
                rows += [(pages[i], k) for i in range(max(low - 1, 0), high)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], ["page", "key"])

    def to_blocks(wanted: pa.Table, directory: pa.Table) -> pa.Table:
        directory = directory.sort_by("block")
        firsts, lasts, blocks = (directory.column(c).to_pylist() for c in ("first_key", "last_key", "block"))
        rows = [(blocks[i], k) for k in wanted.column("key").to_pylist() for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "key": pa.array([k for _, k in rows], pa.string())})

    def to_lines(wanted: pa.Table, block: pa.Table) -> pa.Table:
        lines = _unpack(block.column("data")[0].as_py()) if wanted.num_rows and block.num_rows else []
        names = [x[0] for x in lines]
        return pa.Table.from_batches([_captures([x for k in wanted.column("key").to_pylist() for x in lines[bisect.bisect_left(names, k) : bisect.bisect_right(names, k)]])])

    keys = urls.select("url").distinct().mapInArrow(to_pages, "page int, key string").distinct()
    directory = spark.read.parquet(f"{index}/directory").select("page", "block", "first_key", "last_key")
    found = keys.groupBy("page").cogroup(directory.groupBy("page")).applyInArrow(to_blocks, "block bigint, key string")
    blocks = spark.read.parquet(f"{index}/blocks").select("block", "data")
    return found.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(to_lines, CAPTURE)


def _record(data: bytes, with_payload: bool) -> tuple:
    head, _, block = data.partition(END.encode())
    x = header_fields(head)
    http, _, payload = block.partition(END.encode())
    size, digest = int(header_fields(http)["content-length"]), x["warc-payload-digest"].removeprefix("sha1:")
    if x["warc-type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return unescaped(x.get("page-id")), size, digest, x["warc-type"], unescaped(x.get("refers-to-page-id")), payload if with_payload else None


def _records(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


RECORD = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"
#: Payloads of so many bytes are put out together.
OUT_BYTES = 8 << 20


def fetch(found: DataFrame, with_payload: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """Read the byte range of each capture and parse the record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Captures are dealt out by file and offset, so a task reads neighbouring ranges of few files, about part_bytes in all.
    Digest and size of a response are computed from the payload read, those of a revisit stand in its headers.
    """
    spark = found.sparkSession
    found = materialize(found.select("path", "offset", "length"), "warc-found")
    stats = found.agg(F.sum("length").alias("bytes"), F.min("path").alias("path")).first()

    def run(batches):
        at, file = None, None
        for batch in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != at:
                    if file:
                        file.close()
                    at, file = path, _open(path)
                rows.append(_record(file.read_at(length, offset), with_payload))
                held += length * with_payload
                if held >= OUT_BYTES:
                    yield _records(rows)
                    rows, held = [], 0
            yield _records(rows)
        if file:
            file.close()

    def cut(ranges: pa.Table, files: pa.Table) -> pa.Table:
        if not ranges.num_rows or not files.num_rows:
            return pa.Table.from_batches([_records([])])
        file = _Held(files.column("content")[0].as_py())
        return pa.Table.from_batches([_records([_record(file.read_at(n, at), with_payload) for at, n in zip(*(ranges.column(c).to_pylist() for c in ("offset", "length")))])])

    if stats.path is None or reads_ranges(stats.path):
        dealt = found.repartitionByRange(max(1, math.ceil((stats.bytes or 0) / part_bytes)), "path", "offset").sortWithinPartitions("path", "offset")
        out = dealt.mapInArrow(run, RECORD)
    else:
        files = spark.read.format("binaryFile").load(stats.path.rsplit("/", 1)[0]).select("path", "content")
        out = found.groupBy("path").cogroup(files.groupBy("path")).applyInArrow(cut, RECORD)
    return out if with_payload else out.drop("payload")


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives to the shared folder, index them, look up the URLs of all pages and read their records back."""
    spark = pages.sparkSession
    archives, index = shared_path(spark, "archives"), shared_path(spark, "capture-index")
    write_archives(pages, archives, min_bytes)
    build_index(spark, archives, index)
    kind = pages.schema["page_id"].dataType
    return fetch(lookup(spark, index, pages)).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
