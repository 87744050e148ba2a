"""Shapefiles and their attribute tables, read in pieces: a file isn't one task nor one value in memory.

A table function, joined laterally to the listing of files, cuts each file. A .shp is cut at record boundaries, which its index (.shx) lists, into
pieces of about `piece` bytes; a dBASE table has rows of one width and is cut by their number. The pieces are dealt out to tasks,
and each reads its own range, a block at a time. Without an index, or with one that isn't in the order of the file or reaches beyond it, a .shp
is one piece that is walked record by record, in blocks all the same.

Paths are those that pyarrow knows. A record that the file ends within ends the file. No files, or files without records: no rows.
"""

from __future__ import annotations

import math
import struct
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.common import materialize
from fluvial.sources.arrays import storage

# Shape types with parts (lines and polygons, plain, with z, with m); the length of a file's header.
LINES, POLYGONS = (3, 13, 23), (5, 15, 25)
HEADER = 100
#: Bytes of a file that one task reads; of a read; index entries that are held at once; points and rows put out together.
PIECE, BLOCK, ENTRIES, OUT = 32 << 20, 4 << 20, 1 << 18, 1 << 18


def _place(path: str):
    """(file system, path within it) of a path as Spark lists it, that is without any escapes."""
    if path.startswith("file:"):
        return storage("/" + path[5:].lstrip("/"))
    return storage(path if path.startswith("/") else quote(path, safe="/:@"))


class Window:
    """A range of an open file, read in blocks; take(n) gives the next n bytes, fewer at its end."""

    def __init__(self, file, begin: int, end: int):
        self.file, self.at, self.end, self.held, self.k = file, begin, end, b"", 0

    def take(self, n: int) -> bytes:
        if len(self.held) - self.k < n:
            more = max(min(max(n, BLOCK), self.end - self.at), 0)
            self.file.seek(self.at)
            got = self.file.read(more)
            self.at += len(got)
            self.held, self.k = self.held[self.k :] + got, 0
        out = self.held[self.k : self.k + n]
        self.k += len(out)
        return out


def shapes_of(file, begin: int, end: int, kinds=LINES):
    """(record number, parts) for each shape of a range; parts are arrays of points. Other kinds and empty shapes are skipped."""
    window = Window(file, begin, end)
    while len(head := window.take(8)) == 8:
        number, words = struct.unpack(">ii", head)
        body = window.take(max(2 * words, 0))
        if words < 0 or len(body) < 2 * words:
            return
        if len(body) >= 44 and struct.unpack_from("<i", body)[0] in kinds:
            n_parts, n_points = struct.unpack_from("<ii", body, 36)
            starts = np.frombuffer(body, "<i4", n_parts, 44)
            points = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
            yield number, np.split(points, starts[1:])


def cuts_of_index(file, entries: int, size: int, piece: int) -> list[int]:
    """Offsets, from the first record to the end of a .shp of `size` bytes, at which it can be cut into pieces; entries: records of its .shx."""
    cuts, last = [HEADER], HEADER
    window = Window(file, HEADER, HEADER + 8 * entries)
    while data := window.take(8 * ENTRIES):
        offsets = 2 * np.frombuffer(data[: len(data) // 8 * 8], ">i4").reshape(-1, 2)[:, 0].astype(np.int64)
        if not len(offsets):
            break
        if offsets[0] < last or (np.diff(offsets) < 0).any() or offsets[-1] > size:
            return [HEADER, size]
        last = int(offsets[-1])
        while (k := int(np.searchsorted(offsets, cuts[-1] + piece))) < len(offsets):
            cuts.append(int(offsets[k]))
    return [*cuts, size]


def shape_pieces(path: str, size: int, piece: int = PIECE):
    """(begin, end, bytes) of the pieces of a .shp file; begin and end in bytes."""
    files, at = _place(path)
    index = files.get_file_info(at[:-4] + ".shx")
    if not index.is_file or index.size <= HEADER:
        return [(HEADER, size, size - HEADER)] if size > HEADER else []
    with files.open_input_file(index.path) as f:
        cuts = cuts_of_index(f, (index.size - HEADER) // 8, size, piece)
    return [(a, b, b - a) for a, b in zip(cuts, cuts[1:]) if a < b]


def table_layout(file) -> tuple[int, int, int]:
    """Rows, bytes before them, bytes of each."""
    return struct.unpack("<IHH", Window(file, 4, 12).take(8))


def table_pieces(path: str, size: int, piece: int = PIECE):
    """(begin, end, bytes) of the pieces of a .dbf file; begin and end in rows. Rows that the file lacks aren't read."""
    if size < 32:
        return []
    files, at = _place(path)
    with files.open_input_file(at) as f:
        rows, header, width = table_layout(f)
    rows, step = min(rows, max(size - header, 0) // max(width, 1)), max(piece // max(width, 1), 1)
    return [(a, min(a + step, rows), (min(a + step, rows) - a) * width) for a in range(0, rows, step)]


def _text(kind: str, text: str) -> str | None:
    if kind in "NF":
        text = text if text.strip("*") else ""
    elif kind == "L":
        text = {"y": "true", "t": "true", "n": "false", "f": "false"}.get(text.lower(), "")
    return text or None


def table_of(file, begin: int, end: int, encoding: str = "utf-8"):
    """Pairs of name and text for each row of a range of a dBASE table; a deleted row has none, so that rows keep their numbers."""
    _, header, width = table_layout(file)
    fields, heads, at = [], Window(file, 32, header), 1
    while len(d := heads.take(32)) == 32 and d[0] != 0x0D:
        fields.append((d[:11].split(b"\0")[0].decode(encoding, "replace"), chr(d[11]), at, at + d[16]))
        at += d[16]
    rows = Window(file, header + begin * width, header + end * width)
    for _ in range(begin, end):
        row = rows.take(width)
        yield [] if row[:1] == b"*" else [(name, _text(kind, row[a:b].decode(encoding, "replace").strip("\0 "))) for name, kind, a, b in fields]


def _pieces(spark: SparkSession, path: str, ending: str, cut, piece: int) -> DataFrame:
    """path, begin, end of the pieces of all files at path with that ending, dealt out to tasks."""

    class Pieces:
        def eval(self, path: str, size: int):
            yield from cut(path, size, piece)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(path).select("path", "length")
    made = F.udtf(Pieces, returnType="begin bigint, end bigint, bytes bigint")
    found = files.lateralJoin(made(F.col("path").outer(), F.col("length").outer())).select("path", "begin", "end", "bytes")
    found = materialize(found, "shape-pieces")
    n, total = found.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    # a task for each piece, unless they are small
    return found.drop("bytes").repartition(max(min(n, 4 * math.ceil((total or 0) / piece)), 1), "path", "begin")


_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_LINES = pa.schema([("path", pa.string()), ("record", pa.int32()), ("part", pa.int32()), ("points", _POINTS)])
_ROWS = pa.schema([("path", pa.string()), ("record", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string()))])


def _line_batch(rows: list) -> pa.RecordBatch:
    points = np.concatenate([r[3] for r in rows])
    ends = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _LINES.types[k]) for k in range(3)] + [lists], schema=_LINES)


def _each_piece(batches):
    for batch in batches:
        for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
            files, at = _place(path)
            with files.open_input_file(at) as f:
                yield path, f, begin, end


def read_lines(spark: SparkSession, path: str, polygons: bool = False, piece: int = PIECE) -> DataFrame:
    """path (without ending), record, part, points (structs x, y) of the .shp files at path."""
    kinds = POLYGONS if polygons else LINES

    def run(batches):
        for name, file, begin, end in _each_piece(batches):
            rows, held = [], 0
            for number, parts in shapes_of(file, begin, end, kinds):
                rows += [(name[:-4], number, k, part) for k, part in enumerate(parts)]
                held += sum(map(len, parts)) + len(parts)
                if held >= OUT:
                    yield _line_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _line_batch(rows)

    return _pieces(spark, path, ".shp", shape_pieces, piece).mapInArrow(run, "path string, record int, part int, points array<struct<x:double,y:double>>")


def read_attributes(spark: SparkSession, path: str, encoding: str = "utf-8", piece: int = PIECE) -> DataFrame:
    """path (without ending), record (from 1, as in the .shp file), attributes (a map of texts) of the .dbf files at path."""

    def batch_of(name, first, rows):
        return pa.RecordBatch.from_arrays([pa.array([name[:-4]] * len(rows), pa.string()), pa.array(range(first, first + len(rows)), pa.int32()), pa.array(rows, _ROWS.types[2])], schema=_ROWS)

    def run(batches):
        for name, file, begin, end in _each_piece(batches):
            rows, held, first = [], 0, begin + 1
            for row in table_of(file, begin, end, encoding):
                rows.append(row)
                held += len(row) + 1
                if held >= OUT:
                    yield batch_of(name, first, rows)
                    first, rows, held = first + len(rows), [], 0
            if rows:
                yield batch_of(name, first, rows)

    return _pieces(spark, path, ".dbf", table_pieces, piece).mapInArrow(run, "path string, record int, attributes map<string,string>")


def read_shapefile(spark: SparkSession, path: str, polygons: bool = False, piece: int = PIECE) -> DataFrame:
    return read_lines(spark, path, polygons, piece).join(read_attributes(spark, path, piece=piece), ["path", "record"], "left")


def against_flow(attributes: str = "attributes", name: str = "FLOWDIR"):
    """Whether a line is drawn against the flow."""
    return F.coalesce(F.lower(F.col(attributes)[name]).contains("against"), F.lit(False))
