"""Array containers as tables: Zarr v2 stores and classic NetCDF files, by Spark's Python data sources.

    arrays.register(spark)
    spark.read.format("zarr").option("variables", "rain,temp").load("/data/forcing.zarr").where("time >= '1995-01-01'")
    arrays.write_zarr(df, "/data/forcing.zarr", {"time": 365, "flat_index": 4096}, ["rain", "temp"])

A row is one cell: a column for each dimension (its coordinate, or its index without one; times by their CF units) and one for each
variable, in double; NaN, infinities and fill values are NULL. One partition is one chunk of the first variable (Zarr), or some records (NetCDF), so
a chunk is all that a task holds; other variables may be chunked otherwise. Comparisons with coordinates are pushed down: chunks outside are
not opened. Options: variables (comma-separated; all with the most dimensions otherwise), start and end (of the first time
dimension, both included), rows (cells of a partition of NetCDF). A path may be one container, or a folder of files (*.nc) or yearly stores (1995.zarr); their
cells come one below the other.

Files are opened through pyarrow, so the paths are local ones or of schemes that it knows (file, s3, gs, abfs, hdfs).
"""

from __future__ import annotations

import bz2
import datetime as dt
import gzip
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampNTZType

from fluvial.common import checked_join

#: Cells of a partition of a file without chunks.
ROWS = 1 << 20
#: An axis with more values than this isn't one of a grid.
AXIS_MOST = 10_000_000
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


# -- storage -----------------------------------------------------------------------------------------------------------


def storage(path: str):
    """(file system, path within it)."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+]+:", path) else (fs.LocalFileSystem(), path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"array containers can't be opened at {path}: {e}") from None


def read_bytes(path: str, offset: int = 0, length: int | None = None) -> bytes | None:
    """None if there is no such file."""
    files, at = storage(path)
    try:
        with files.open_input_file(at) as f:
            f.seek(offset)
            return f.read(length) if length is not None else f.read()
    except (FileNotFoundError, NotADirectoryError):
        return None


def write_bytes(path: str, data: bytes) -> None:
    files, at = storage(path)
    if folder := at.rpartition("/")[0]:
        files.create_dir(folder)
    with files.open_output_stream(at) as f:
        f.write(data)


def list_paths(path: str) -> list[str]:
    """Files and folders in a folder, by name; nothing for a file."""
    from pyarrow import fs

    files, at = storage(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        return []
    return sorted(f"{path.rstrip('/')}/{i.base_name}" for i in files.get_file_info(fs.FileSelector(at)))


# -- arrays ------------------------------------------------------------------------------------------------------------


@dataclass
class Array:
    """An array of a container: name, dimensions, shape, type, how it is cut, and attributes."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: np.dtype
    chunks: tuple[int, ...]
    attrs: dict
    place: dict = field(default_factory=dict)


def decoded(a: Array, values: np.ndarray) -> np.ndarray:
    """Doubles with NaN for missing values, scaled as the attributes say."""
    out = values.astype(np.float64)
    for name in ("_FillValue", "missing_value"):
        v = a.attrs.get(name)
        if v is not None:
            out[np.isin(values, np.atleast_1d(v).astype(values.dtype))] = np.nan
    out = out * float(np.atleast_1d(a.attrs.get("scale_factor", 1.0))[0]) + float(np.atleast_1d(a.attrs.get("add_offset", 0.0))[0])
    return np.where(np.isfinite(out), out, np.nan)


def times(values: np.ndarray, units: str) -> np.ndarray | None:
    """Microseconds since 1970 of values with CF units ("days since 1990-01-01 00:00:00"); None if these are no units of time."""
    m = re.fullmatch(r"(second|minute|hour|day)s?\s+since\s+(\d{4}-\d{1,2}-\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2})?)(?:\.\d+)?)?\s*(?:Z|UTC)?", units.strip())
    if not m:
        return None
    y, mo, d = map(int, m[2].split("-"))
    h, mi, s = ([int(x) for x in (m[3] or "0:0:0").split(":")] + [0])[:3]
    origin = (dt.datetime(y, mo, d, h, mi, s) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    return origin + np.rint(np.asarray(values, np.float64) * SECONDS[m[1]] * 1e6).astype(np.int64)


class Zarr:
    """A Zarr v2 store. A chunk that isn't there is full of the fill value."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.arrays: dict[str, Array] = {}
        whole = read_bytes(f"{self.path}/.zmetadata")
        if whole:
            meta = json.loads(whole)["metadata"]
        else:
            meta = {}
            for p in list_paths(self.path):
                for kind in (".zarray", ".zattrs"):
                    data = read_bytes(f"{p}/{kind}")
                    if data:
                        meta[f"{p.rpartition('/')[2]}/{kind}"] = json.loads(data)
        for key, m in meta.items():
            name, _, kind = key.rpartition("/")
            if kind != ".zarray" or not name:
                continue
            if m.get("filters"):
                raise ValueError(f"{self.path}: filters {m['filters']} of {name} aren't known")
            attrs = dict(meta.get(f"{name}/.zattrs", {}))
            dims = tuple(attrs.get("_ARRAY_DIMENSIONS", [f"dim_{k}" for k in range(len(m["shape"]))]))
            fill = m.get("fill_value")
            place = {"compressor": m.get("compressor"), "order": m.get("order", "C"), "fill": math.nan if fill in (None, "NaN") else float(fill), "sep": m.get("dimension_separator", ".")}
            if fill is not None and fill != "NaN" and np.dtype(m["dtype"]).kind == "f":
                attrs.setdefault("_FillValue", fill)
            self.arrays[name] = Array(name, dims, tuple(m["shape"]), np.dtype(m["dtype"]), tuple(m["chunks"]), attrs, place)

    def read(self, a: Array, where: tuple[slice, ...]) -> np.ndarray:
        """A region, put together from the chunks that it touches."""
        whole = a.dtype if a.dtype.kind == "f" or not math.isnan(a.place["fill"]) else np.dtype("f8")
        out = np.full([s.stop - s.start for s in where], a.place["fill"], whole)
        for at in np.ndindex(*[-(-s.stop // c) - s.start // c for s, c in zip(where, a.chunks)]):
            at = tuple(k + s.start // c for k, s, c in zip(at, where, a.chunks))
            data = read_bytes(f"{self.path}/{a.name}/{a.place['sep'].join(map(str, at)) or '0'}")
            if data is None:
                continue
            block = np.frombuffer(decompress(data, a.place["compressor"]), a.dtype).reshape(a.chunks, order=a.place["order"])
            low = [max(s.start, k * c) for s, k, c in zip(where, at, a.chunks)]
            high = [min(s.stop, (k + 1) * c) for s, k, c in zip(where, at, a.chunks)]
            inner = tuple(slice(lo - k * c, hi - k * c) for lo, hi, k, c in zip(low, high, at, a.chunks))
            out[tuple(slice(lo - s.start, hi - s.start) for lo, hi, s in zip(low, high, where))] = block[inner]
        return out


def decompress(data: bytes, how: Mapping | None) -> bytes:
    kind = (how or {}).get("id")
    if kind is None:
        return data
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "bz2":
        return bz2.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compressor {kind!r} isn't known; there are zlib, gzip, bz2, zstd and none")


# Types of the classic NetCDF format by number.
NETCDF_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class NetCDF:
    """A classic NetCDF file (versions 1, 2 and 5). Only the header is read to open it."""

    def __init__(self, path: str):
        self.path, self.arrays = path, {}
        size = 1 << 16
        while True:  # the header's length isn't known beforehand
            self._data, self._at = read_bytes(path, 0, size), 0
            if self._data is None:
                raise FileNotFoundError(path)
            try:
                self._header()
                break
            except (struct.error, IndexError):
                if len(self._data) < size:
                    raise ValueError(f"{path}: the header is cut off") from None
                size *= 8
        del self._data

    def _number(self, kind: str = "i") -> int:
        kind = "q" if kind == "n" and self.version == 5 else "i" if kind == "n" else kind
        v = struct.unpack_from(">" + kind, self._data, self._at)[0]
        self._at += struct.calcsize(kind)
        return v

    def _text(self) -> str:
        n = self._number("n")
        if self._at + n > len(self._data):
            raise IndexError
        s = self._data[self._at : self._at + n].decode()
        self._at += -(-n // 4) * 4
        return s

    def _attributes(self) -> dict:
        out = {}
        self._number()
        for _ in range(self._number("n")):
            name = self._text()
            dtype, n = np.dtype(NETCDF_TYPES[self._number()]), self._number("n")
            if self._at + n * dtype.itemsize > len(self._data):
                raise IndexError
            values = np.frombuffer(self._data, dtype, n, self._at)
            out[name] = values.tobytes().decode(errors="replace") if dtype.kind == "S" else values.tolist()
            self._at += -(-n * dtype.itemsize // 4) * 4
        return out

    def _header(self) -> None:
        if self._data[:3] != b"CDF" or self._data[3] not in (1, 2, 5):
            kind = "an HDF5 container, which isn't read" if self._data[:4] == b"\x89HDF" else "no classic NetCDF"
            raise ValueError(f"{self.path} is {kind}")
        self.version, self._at, self.arrays = self._data[3], 4, {}
        records = self._number("n")
        self._number()
        dims = [(self._text(), self._number("n")) for _ in range(self._number("n"))]
        self.attrs = self._attributes()
        self._number()
        found = []
        for _ in range(self._number("n")):
            name = self._text()
            ids = [self._number("n") for _ in range(self._number("n"))]
            attrs, kind = self._attributes(), np.dtype(NETCDF_TYPES[self._number()])
            self._number("n")
            found.append((name, ids, attrs, kind, self._number("i" if self.version == 1 else "q")))
        of_record = lambda ids: bool(ids) and dims[ids[0]][1] == 0
        sizes = {name: int(np.prod([dims[i][1] for i in ids[1:]], dtype=np.int64)) * kind.itemsize for name, ids, _, kind, _ in found if of_record(ids)}
        # records hold one slab of each record variable, padded to four bytes unless there is only one
        step = sum(n if len(sizes) == 1 else -(-n // 4) * 4 for n in sizes.values())
        for name, ids, attrs, kind, begin in found:
            shape = tuple(records if k == 0 and of_record(ids) else dims[i][1] for k, i in enumerate(ids))
            row = int(np.prod(shape[1:], dtype=np.int64)) if shape else 1
            chunks = (max(1, ROWS // max(row, 1)), *shape[1:]) if shape else ()
            self.arrays[name] = Array(name, tuple(dims[i][0] for i in ids), shape, kind, chunks, attrs, {"begin": begin, "step": step if of_record(ids) else row * kind.itemsize, "packed": not of_record(ids) or len(sizes) == 1})

    def read(self, a: Array, where: tuple[slice, ...]) -> np.ndarray:
        if not a.shape:
            return np.frombuffer(read_bytes(self.path, a.place["begin"], a.dtype.itemsize), a.dtype).reshape(())
        first, row = where[0], int(np.prod(a.shape[1:], dtype=np.int64))
        n, step = first.stop - first.start, a.place["step"]
        if n <= 0:
            return np.zeros([0, *[s.stop - s.start for s in where[1:]]], a.dtype)
        data = read_bytes(self.path, a.place["begin"] + first.start * step, (n - 1) * step + row * a.dtype.itemsize)
        slabs = np.ndarray((n, row), a.dtype, data, strides=(step, a.dtype.itemsize))
        return slabs.reshape(n, *a.shape[1:])[(slice(None), *where[1:])]


def netcdf_bytes(dims: Mapping[str, int], variables: Mapping[str, tuple[Sequence[str], np.ndarray, Mapping]], attrs: Mapping | None = None, record: str | None = None) -> bytes:
    """A classic NetCDF file with 64-bit offsets. record: the dimension that may grow; it must be the first of its variables'."""
    numbers = {np.dtype(t).newbyteorder("="): k for k, t in NETCDF_TYPES.items() if k <= 6 and t != "S1"}
    pad = lambda b: b + bytes(-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s.encode())) + pad(s.encode())

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attribute(name, v) -> bytes:
        if isinstance(v, str):
            return text(name) + struct.pack(">ii", 2, len(v.encode())) + pad(v.encode())
        v = np.atleast_1d(np.asarray(v, np.float64 if not isinstance(v, (int, np.integer)) else np.int32))
        return text(name) + struct.pack(">ii", numbers[v.dtype], len(v)) + pad(v.astype(v.dtype.newbyteorder(">")).tobytes())

    names = list(dims)
    arrays = {n: (d, np.asarray(v), a) for n, (d, v, a) in variables.items()}
    growing = [n for n, (d, _, _) in arrays.items() if d and d[0] == record]
    fixed = [n for n in arrays if n not in growing]
    data = {n: v.astype(v.dtype.newbyteorder(">")) for n, (_, v, _) in arrays.items()}
    slab = {n: int(np.prod(data[n].shape[1:], dtype=np.int64)) * data[n].dtype.itemsize for n in growing}
    padded = {n: slab[n] if len(growing) == 1 else -(-slab[n] // 4) * 4 for n in growing}
    size = {n: -(-data[n].nbytes // 4) * 4 for n in fixed} | padded

    def header(begin: Mapping[str, int]) -> bytes:
        head = b"CDF\x02" + struct.pack(">i", dims[record] if record else 0)
        head += listed(10, [text(n) + struct.pack(">i", 0 if n == record else dims[n]) for n in names])
        head += listed(12, [attribute(k, v) for k, v in (attrs or {}).items()])
        each = []
        for n, (d, v, a) in arrays.items():
            each.append(text(n) + struct.pack(">i", len(d)) + b"".join(struct.pack(">i", names.index(x)) for x in d) + listed(12, [attribute(k, x) for k, x in a.items()]) + struct.pack(">iiq", numbers[v.dtype.newbyteorder("=")], min(size[n], 2**31 - 4), begin[n]))
        return head + listed(11, each)

    at, begin = len(header(dict.fromkeys(arrays, 0))), {}
    for n in [*fixed, *growing]:
        begin[n], at = at, at + size[n]
    out = [header(begin), *(pad(data[n].tobytes()) for n in fixed)]
    for k in range(dims[record] if growing else 0):
        out += [(b := data[n][k : k + 1].tobytes()) + bytes(padded[n] - len(b)) for n in growing]
    return b"".join(out)


# -- reading -----------------------------------------------------------------------------------------------------------


def containers(path: str, kind: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> list[str]:
    """The path itself, or the files or stores in the folder; of those named after a year only the years of the period."""
    inside = [p for p in list_paths(path) if p.endswith(".zarr" if kind == "zarr" else (".nc", ".nc3", ".cdf", ".netcdf"))]
    if not inside:
        return [path]

    def wanted(p: str) -> bool:
        year = re.fullmatch(r"(\d{4})\.\w+", p.rpartition("/")[2])
        return not year or (start is None or int(year[1]) >= start.year) and (end is None or int(year[1]) <= end.year)

    return [p for p in inside if wanted(p)]


@dataclass
class Chunk(InputPartition):
    path: str
    where: tuple

    def __init__(self, path: str, where: tuple):
        self.path, self.where, self.value = path, where, path


class ArrayReader(DataSourceReader):
    def __init__(self, source: "ArraySource"):
        self.source = source
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        kinds = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "=", In: "in"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in self.source.dims:
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            yield f  # rows of an opened chunk are still tested by Spark

    def _may_hold(self, dim: str, low, high) -> bool:
        """Whether a chunk with coordinates from low to high may hold rows that pass the tests."""
        for name, op, value in self.tests:
            if name != dim:
                continue
            if op == "in":
                ok = any(v is not None and low <= self.source.plain(dim, v) <= high for v in value)
            else:
                v = self.source.plain(dim, value)
                ok = {">": high > v, ">=": high >= v, "<": low < v, "<=": low <= v, "=": low <= v <= high}[op]
            if not ok:
                return False
        return True

    def partitions(self) -> Sequence[Chunk]:
        out = []
        for path in self.source.paths:
            box = self.source.open(path)
            lead = box.arrays[self.source.variables[0]]
            axes = {d: self.source.axis(box, d, n) for d, n in zip(lead.dims, lead.shape)}
            cuts = []
            for d, n, c in zip(lead.dims, lead.shape, lead.chunks):
                pieces = [slice(k, min(k + c, n)) for k in range(0, n, c)]
                cuts.append([s for s in pieces if self._may_hold(d, axes[d][s].min(), axes[d][s].max())])
            out += [Chunk(path, tuple((cuts[d][k].start, cuts[d][k].stop) for d, k in enumerate(at))) for at in np.ndindex(*map(len, cuts))]
        return out or [Chunk("", ())]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        if not chunk.path:
            return
        box, source = self.source.open(chunk.path), self.source
        lead = box.arrays[source.variables[0]]
        where = dict(zip(lead.dims, (slice(*w) for w in chunk.where)))
        shape = [s.stop - s.start for s in where.values()]
        cols = []
        for k, d in enumerate(lead.dims):
            axis = source.axis(box, d, lead.shape[k])[where[d]]
            cols.append(np.broadcast_to(axis.reshape([-1 if j == k else 1 for j in range(len(shape))]), shape).ravel())
        values = []
        for v in source.variables:
            a = box.arrays[v]
            part = decoded(a, box.read(a, tuple(where[d] for d in a.dims)))
            # a variable without some of the dimensions is the same along them
            part = part.reshape([shape[k] if d in a.dims else 1 for k, d in enumerate(lead.dims)])
            values.append(np.broadcast_to(part, shape).ravel())
        keep = np.ones(len(cols[0]) if cols else 1, bool)
        for d, c in zip(lead.dims, cols):
            if source.typed[d] == "time":
                keep &= (c >= source.start if source.start is not None else True) & (c <= source.end if source.end is not None else True)
        if source.drop_missing:
            keep &= np.any(~np.isnan(np.stack(values)), axis=0)
        types = {"time": pa.timestamp("us"), "number": pa.float64(), "index": pa.int64()}
        at = np.flatnonzero(keep)
        for k in range(0, len(at), 1 << 16):
            rows = at[k : k + (1 << 16)]
            arrays = [pa.array(c[rows]).cast(types[source.typed[d]]) for d, c in zip(lead.dims, cols)]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v[rows], mask=np.isnan(v[rows])) for v in values)], [*lead.dims, *source.variables])


class ArraySource(DataSource):
    kind = ""

    def __init__(self, options: Mapping[str, str]):
        self.options = options
        self._ready = False

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def open(self, path: str):
        return Zarr(path) if self.kind == "zarr" else NetCDF(path)

    def _prepare(self) -> None:
        if self._ready:
            return
        o, moment = self.options, lambda s: None if s is None else dt.datetime.fromisoformat(s)
        start, end = moment(o.get("start")), moment(o.get("end"))
        micros = lambda t: None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        self.start, self.end = micros(start), micros(end)
        self.rows, self.drop_missing = int(o.get("rows", ROWS)), o.get("missing", "keep") == "drop"
        self.paths = containers(o["path"], self.kind, start, end)
        if not self.paths:
            raise FileNotFoundError(f"no container of {o['path']} is of the period")
        box = self.open(self.paths[0])
        most = max((len(a.dims) for a in box.arrays.values()), default=0)
        given = [v.strip() for v in o["variables"].split(",")] if o.get("variables") else [n for n, a in box.arrays.items() if len(a.dims) == most and n not in ("crs", "reference_time", *a.dims) and a.dtype.kind in "iuf"]
        missing = [v for v in given if v not in box.arrays]
        if missing or not given:
            raise KeyError(f"missing variables {missing}; there are {sorted(box.arrays)}")
        # the one with the most dimensions leads
        self.variables = sorted(given, key=lambda v: -len(box.arrays[v].dims))
        self.dims = box.arrays[self.variables[0]].dims
        for v in self.variables:
            if not set(box.arrays[v].dims) <= set(self.dims):
                raise ValueError(f"{v} has other dimensions than {self.variables[0]}")
        self.typed = {d: self._kind(box, d) for d in self.dims}
        self._ready = True

    @staticmethod
    def _kind(box, d: str) -> str:
        a = box.arrays.get(d)
        if a is None or a.dims != (d,):
            return "index"
        if times(np.zeros(0), str(a.attrs.get("units", ""))) is not None:
            return "time"
        return "number" if a.dtype.kind == "f" else "index"

    def axis(self, box, d: str, n: int) -> np.ndarray:
        """The coordinates of a dimension, as microseconds, doubles or integers."""
        a = box.arrays.get(d)
        if a is None or a.dims != (d,):
            return np.arange(n)
        values = box.read(a, (slice(0, a.shape[0]),))
        if self.typed[d] == "time":
            return times(values, str(a.attrs["units"]))
        return values.astype(np.float64 if self.typed[d] == "number" else np.int64)

    def plain(self, d: str, value):
        """A value of a filter as in axis()."""
        if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            value = dt.datetime(value.year, value.month, value.day)
        return (value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) if isinstance(value, dt.datetime) else value

    def schema(self) -> StructType:
        self._prepare()
        types = {"time": TimestampNTZType(), "number": DoubleType(), "index": LongType()}
        return StructType([StructField(d, types[self.typed[d]]) for d in self.dims] + [StructField(v, DoubleType()) for v in self.variables])

    def reader(self, schema: StructType) -> ArrayReader:
        self._prepare()
        reader = ArrayReader(self)
        for name, op, value in (("start", ">=", self.start), ("end", "<=", self.end)):
            at = next((d for d in self.dims if self.typed[d] == "time"), None)
            if value is not None and at is None:
                raise ValueError(f"{name} is given, but no dimension is a time")
            if value is not None:
                reader.tests.append((at, op, value))
        return reader

    def writer(self, schema: StructType, overwrite: bool) -> "ChunkWriter":
        if self.kind != "zarr":
            raise ValueError("tables are written as Zarr")
        return ChunkWriter(self.options)


class ZarrSource(ArraySource):
    kind = "zarr"


class NetCDFSource(ArraySource):
    kind = "netcdf"


def register(spark: SparkSession) -> None:
    """The formats zarr and netcdf for this session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZarrSource, NetCDFSource):
        spark.dataSource.register(source)


def read_arrays(spark: SparkSession, path: str, variables: Sequence[str] | None = None, start=None, end=None, kind: str | None = None, **options) -> DataFrame:
    """The cells of a container, or of all in a folder. kind: zarr or netcdf, by the name if not given."""
    register(spark)
    kind = kind or ("netcdf" if re.search(r"\.(nc|nc3|cdf|netcdf)/?$", path) or any(p.endswith(".nc") for p in list_paths(path)) else "zarr")
    given = {"variables": ",".join(variables) if variables else None, "start": None if start is None else str(start), "end": None if end is None else str(end), **options}
    return spark.read.format(kind).options(**{k: v for k, v in given.items() if v is not None}).load(path)


# -- writing -----------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    chunks: list


class ChunkWriter(DataSourceArrowWriter):
    """Writes chunks, one after the other, from rows sorted by chunk: chunk, cell (its place in the chunk), variables.

    A chunk's file has the same name and content in each attempt, so a task that runs again, or twice, does no harm. What the
    store is gets written in commit(): a store without it has no variables.
    """

    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"].rstrip("/")
        self.plan = json.loads(options["plan"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        variables, shape, counts = self.plan["variables"], self.plan["chunks"], self.plan["grid"]
        now, held, done = None, {}, []

        def flush():
            if now is None:
                return
            at = ".".join(map(str, np.unravel_index(now, counts)))
            for v in variables:
                write_bytes(f"{self.path}/{v}/{at}", zlib.compress(held[v].astype("<f8").tobytes(), 4))
            done.append(int(now))

        for batch in iterator:
            chunk, cell = batch.column("chunk").to_numpy(), batch.column("cell").to_numpy()
            for k in np.unique(chunk):
                if k != now:
                    flush()
                    now, held = k, {v: np.full(int(np.prod(shape)), np.nan) for v in variables}
                rows = chunk == k
                for v in variables:
                    held[v][cell[rows]] = batch.column(v).to_numpy(zero_copy_only=False)[rows]
        flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        p, meta = self.plan, {".zgroup": {"zarr_format": 2}, ".zattrs": {}}
        for name, a in p["arrays"].items():
            meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": a["shape"], "chunks": a["chunks"], "dtype": a["dtype"], "compressor": {"id": "zlib", "level": 4}, "fill_value": a["fill"], "order": "C", "filters": None}
            meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": a["dims"], **a["attrs"]}
            if "values" in a:
                write_bytes(f"{self.path}/{name}/0", zlib.compress(np.array(a["values"], a["dtype"]).tobytes(), 4))
        for key, value in meta.items():
            write_bytes(f"{self.path}/{key}", json.dumps(value).encode())
        write_bytes(f"{self.path}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        counts = self.plan["grid"]
        for message in messages:
            for k in message.chunks if message else []:
                for v in self.plan["variables"]:
                    files, at = storage(f"{self.path}/{v}/{'.'.join(map(str, np.unravel_index(k, counts)))}")
                    files.delete_file(at)


def write_zarr(df: DataFrame, path: str, chunks: Mapping[str, int], variables: Sequence[str], mode: str = "fail") -> None:
    """A Zarr store of the variables over the dimensions that are the keys of chunks, in this order, cut as it says.

    Cells that df lacks are missing. Of rows of one cell any one counts. mode: fail or overwrite if there is a store, or append, which adds to the first dimension, whose coordinates must be later
    than the store's, and whose stored length must be whole chunks. Each chunk is put together in one task; the axes, that is one
    number for each coordinate of each dimension, are what the driver holds.
    """
    spark, dims = df.sparkSession, list(chunks)
    register(spark)
    exists = read_bytes(f"{path.rstrip('/')}/.zmetadata") is not None
    if exists and mode == "fail":
        raise FileExistsError(path)
    files, at = storage(path)
    if exists and mode == "overwrite":
        files.delete_dir(at)
    files.create_dir(at)
    kinds = dict(df.dtypes)
    axes, arrays, plain = {}, {}, df
    for d in dims:
        if kinds[d] in ("date", "timestamp", "timestamp_ntz"):
            plain = plain.withColumn(d, F.unix_micros(F.col(d).cast("timestamp_ntz").cast("timestamp")))
    for d in dims:
        values = [r[0] for r in plain.select(d).where(F.col(d).isNotNull()).distinct().limit(AXIS_MOST + 1).toLocalIterator()]
        if len(values) > AXIS_MOST:
            raise ValueError(f"{d} has more than {AXIS_MOST} coordinates")
        axes[d] = sorted(values)
    if exists and mode == "append":
        old = Zarr(path)
        for d in dims:
            stored = old.read(old.arrays[d], (slice(0, old.arrays[d].shape[0]),)).astype(old.arrays[d].dtype).tolist()
            if kinds[d] in ("date", "timestamp", "timestamp_ntz"):
                stored = times(np.array(stored), old.arrays[d].attrs["units"]).tolist()
            if d == dims[0]:
                if len(stored) % chunks[d] or axes[d] and stored and axes[d][0] <= stored[-1]:
                    raise ValueError(f"only later coordinates can be appended, after whole chunks of {d}")
                axes[d] = stored + axes[d]
            elif not set(axes[d]) <= set(stored):
                raise ValueError(f"{d} has coordinates that the store lacks")
            else:
                axes[d] = stored
    for d in dims:
        number = kinds[d] in ("double", "float")
        time = kinds[d] in ("date", "timestamp", "timestamp_ntz")
        if time and any(v % 1_000_000 for v in axes[d]):
            raise ValueError(f"{d} has fractions of seconds")
        values = [v // 1_000_000 for v in axes[d]] if time else axes[d]
        arrays[d] = {"shape": [len(values)], "chunks": [max(1, len(values))], "dtype": "<f8" if number else "<i8", "fill": None, "dims": [d], "attrs": {"units": "seconds since 1970-01-01 00:00:00"} if time else {}, "values": values}
    shape = [len(axes[d]) for d in dims]
    grid = [max(1, -(-n // chunks[d])) for n, d in zip(shape, dims)]
    for v in variables:
        arrays[v] = {"shape": shape, "chunks": [chunks[d] for d in dims], "dtype": "<f8", "fill": "NaN", "dims": dims, "attrs": {}}
    placed = plain
    for d in dims:
        kind = plain.schema[d].dataType.simpleString()
        axis = spark.createDataFrame(list(enumerate(axes[d])), f"`_{d}` bigint, `{d}` {kind}")
        placed = checked_join(placed, axis, d, "inner", row_bytes=32)
    chunk, cell = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for d, n in zip(dims, grid):
        chunk = chunk * n + F.floor(F.col(f"_{d}") / chunks[d])
        cell = cell * chunks[d] + F.col(f"_{d}") % chunks[d]
    out = placed.select(chunk.cast("bigint").alias("chunk"), cell.cast("bigint").alias("cell"), *[F.col(v).cast("double").alias(v) for v in variables])
    plan = {"variables": list(variables), "chunks": [chunks[d] for d in dims], "grid": grid, "arrays": arrays}
    out.repartition("chunk").sortWithinPartitions("chunk").write.format("zarr").option("plan", json.dumps(plan)).mode("append").save(path)


def write_netcdf(df: DataFrame, path: str, file: str, dims: Sequence[str], variables: Sequence[str]) -> None:
    """A classic NetCDF file for each value of the column `file`, with that name; the first dimension is the one that grows.

    A file is made by one task, so the column must cut the table into files that fit in one: a file for each day, month or year, as forcing has. Cells that df
    lacks are missing.
    """
    import pandas as pd

    at = path.rstrip("/")
    times_in = [d for d, t in df.dtypes if d in dims and t in ("date", "timestamp", "timestamp_ntz")]
    d = df.select(F.col(file).cast("string").alias("_file"), *[F.unix_seconds(F.col(c).cast("timestamp_ntz").cast("timestamp")).alias(c) if c in times_in else F.col(c) for c in dims], *[F.col(v).cast("double").alias(v) for v in variables])

    def run(part: "pd.DataFrame") -> "pd.DataFrame":
        axes = {c: np.sort(part[c].unique()) for c in dims}
        place = tuple(np.searchsorted(axes[c], part[c].to_numpy()) for c in dims)
        content = {c: ([c], x.astype(np.float64 if c in times_in or x.dtype.kind == "f" else np.int32), {"units": "seconds since 1970-01-01 00:00:00"} if c in times_in else {}) for c, x in axes.items()}
        for v in variables:
            cells = np.full([len(x) for x in axes.values()], np.nan)
            cells[place] = part[v].to_numpy()
            content[v] = (list(dims), cells, {})
        write_bytes(f"{at}/{part['_file'].iloc[0]}", netcdf_bytes({c: len(x) for c, x in axes.items()}, content, record=dims[0]))
        return pd.DataFrame({"file": [part["_file"].iloc[0]], "cells": [len(part)]})

    d.groupBy("_file").applyInPandas(run, "file string, cells bigint").write.format("noop").mode("overwrite").save()

