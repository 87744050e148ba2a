"""Zarr and NetCDF containers: bytes by the formats' public descriptions, chunks opened, appends, faults."""

import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.sources import arrays


@pytest.fixture
def cube(spark):
    rng = np.random.default_rng(0)
    rows = [(dt.date(2000, 1, 1) + dt.timedelta(days=i), c, float(rng.integers(1000)), float(i)) for i in range(100) for c in range(7) if c == 0 or rng.random() < 0.6]
    return spark.createDataFrame(rows, "time date, cell bigint, rain double, temp double")


def rows(df):
    return sorted((str(r.time)[:10], r.cell, r.rain, r.temp) for r in df.collect())


def test_zarr_round_trip_opens_only_chunks_of_the_period(spark, cube, tmp_path, monkeypatch):
    path = str(tmp_path / "a.zarr")
    arrays.write_zarr(cube, path, {"time": 10, "cell": 3}, ["rain", "temp"])
    whole = arrays.read_arrays(spark, path, missing="drop")
    assert rows(whole) == rows(cube) and whole.rdd.getNumPartitions() == 30
    some = whole.where("time >= timestamp_ntz'2000-01-15' AND time < timestamp_ntz'2000-02-05' AND cell IN (0, 1)")
    assert some.rdd.getNumPartitions() == 3 and rows(some) == rows(cube.where("time >= '2000-01-15' AND time < '2000-02-05' AND cell < 2"))
    part = arrays.read_arrays(spark, path, ["temp"], start="2000-04-01", end="2000-04-05", missing="drop")
    assert part.rdd.getNumPartitions() == 3 and part.columns == ["time", "cell", "temp"] and part.count() == cube.where("time BETWEEN '2000-04-01' AND '2000-04-05'").count()
    assert whole.where("cell = 99").count() == 0
    opened = []
    monkeypatch.setattr(arrays, "read_bytes", lambda p, *a, f=arrays.read_bytes: (opened.append(p), f(p, *a))[1])
    store = arrays.Zarr(path)
    store.read(store.arrays["rain"], (slice(5, 12), slice(0, 3)))
    assert [p.rpartition("/")[2] for p in opened[1:]] == ["0.0", "1.0"]


def test_zarr_modes(spark, cube, tmp_path):
    path = str(tmp_path / "a.zarr")
    first, second = cube.where("temp < 50"), cube.where("temp >= 50")
    arrays.write_zarr(first, path, {"time": 10, "cell": 3}, ["rain", "temp"])
    with pytest.raises(FileExistsError):
        arrays.write_zarr(first, path, {"time": 10, "cell": 3}, ["rain"])
    arrays.write_zarr(second, path, {"time": 10, "cell": 3}, ["rain", "temp"], mode="append")
    assert rows(arrays.read_arrays(spark, path, missing="drop")) == rows(cube)
    with pytest.raises(ValueError, match="later"):
        arrays.write_zarr(first, path, {"time": 10, "cell": 3}, ["rain", "temp"], mode="append")
    arrays.write_zarr(second, path, {"time": 10, "cell": 3}, ["rain", "temp"], mode="overwrite")
    assert rows(arrays.read_arrays(spark, path, missing="drop")) == rows(second)
    arrays.write_zarr(cube.limit(0), path, {"time": 10, "cell": 3}, ["rain", "temp"], mode="overwrite")
    assert arrays.read_arrays(spark, path).count() == 0


def test_zarr_of_others(spark, tmp_path):
    """A store as other writers leave it: no consolidated metadata, Fortran order, fill values, scales, a missing chunk, several codecs."""
    values = np.arange(24, dtype="<i2").reshape(4, 6)

    def put(name, a, chunks, codec=None, order="C", attrs=None, fill=None, skip=(), dims=("y", "x")):
        at = tmp_path / "o.zarr" / name
        at.mkdir(parents=True)
        (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": codec and {"id": codec}, "fill_value": fill, "order": order, "filters": None}))
        (at / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims[: a.ndim], **(attrs or {})}))
        for i in range(-(-a.shape[0] // chunks[0])):
            for j in range(-(-a.shape[1] // chunks[1])) if a.ndim == 2 else [0]:
                block = np.zeros(chunks, a.dtype)
                part = a[i * chunks[0] : (i + 1) * chunks[0]] if a.ndim == 1 else a[i * chunks[0] : (i + 1) * chunks[0], j * chunks[1] : (j + 1) * chunks[1]]
                block[tuple(slice(0, n) for n in part.shape)] = part
                data = block.tobytes(order)
                import bz2, gzip, zstandard  # noqa: E401

                data = {None: lambda b: b, "zlib": zlib.compress, "gzip": gzip.compress, "bz2": bz2.compress, "zstd": zstandard.compress}[codec](data)
                if (i, j) not in skip:
                    (at / (f"{i}.{j}" if a.ndim == 2 else f"{i}")).write_bytes(data)

    (tmp_path / "o.zarr").mkdir()
    (tmp_path / "o.zarr" / ".zgroup").write_text('{"zarr_format": 2}')
    put("a", values, (3, 4), "gzip", "F", {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": 7}, 0)
    put("b", values.astype(">f8"), (2, 5), "zstd", skip=[(0, 0)], fill="NaN")
    put("c", values.astype("<f4"), (4, 6), "bz2", fill=5.0)
    put("x", np.array([10.5, 20.5, 30.5, 40.5, 50.5, 60.5]), (6,), "zlib", dims=("x",))
    put("crs", values, (4, 6))
    got = {(r.y, r.x): (r.a, r.b, r.c) for r in arrays.read_arrays(spark, str(tmp_path / "o.zarr")).collect()}
    want = {(i, 10.5 + 10 * j): (None if values[i, j] == 7 else values[i, j] * 0.5 + 1, None if i < 2 and j < 5 else float(values[i, j]), None if values[i, j] == 5 else float(values[i, j])) for i in range(4) for j in range(6)}
    assert got == want
    (tmp_path / "o.zarr" / "a" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [4, 6], "chunks": [3, 4], "dtype": "<i2", "compressor": {"id": "blosc"}, "fill_value": 0, "order": "C", "filters": None}))
    with pytest.raises(Exception, match="blosc"):
        arrays.read_arrays(spark, str(tmp_path / "o.zarr"), ["a"]).collect()


def netcdf_samples():
    """A file put together by hand: dimensions t (unlimited, 2 records) and x (3), a fixed and two record variables of which one is padded."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + bytes(-len(s) % 4)
    dims = struct.pack(">ii", 10, 2) + name("t") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 3)
    attr = lambda key, v: name(key) + struct.pack(">ii", 2, len(v)) + v.encode() + bytes(-len(v) % 4)
    units = struct.pack(">ii", 12, 1) + attr("units", "days since 2000-01-01")
    none = struct.pack(">ii", 0, 0)

    def head(begins):
        out = b"CDF\x01" + struct.pack(">i", 2) + dims + none + struct.pack(">ii", 11, 3)
        out += name("x") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 5, 12, begins[0])
        out += name("t") + struct.pack(">ii", 1, 0) + units + struct.pack(">iii", 6, 8, begins[1])
        return out + name("v") + struct.pack(">iii", 2, 0, 1) + none + struct.pack(">iii", 3, 8, begins[2])

    n = len(head((0, 0, 0)))
    data = head((n, n + 12, n + 20)) + struct.pack(">3f", 1, 2, 3)
    for t, v in ((0.5, (1, 2, 3)), (2.0, (4, 5, 6))):
        data += struct.pack(">d", t) + struct.pack(">3h", *v) + b"\0\0"
    made = arrays.netcdf_bytes({"t": 2, "x": 3}, {"x": (["x"], np.array([1, 2, 3], "f4"), {}), "t": (["t"], np.array([0.5, 2.0]), {"units": "days since 2000-01-01"}), "v": (["t", "x"], np.array([[1, 2, 3], [4, 5, 6]], "i2"), {})}, record="t")
    return data, made


def test_netcdf_read(spark, tmp_path):
    for k, data in enumerate(netcdf_samples()):
        (tmp_path / f"{k}.nc").write_bytes(data)
        got = arrays.read_arrays(spark, str(tmp_path / f"{k}.nc"), ["v"]).collect()
        assert [(str(r.t), r.x, r.v) for r in got] == [(t, float(x + 1), float(3 * i + x + 1)) for i, t in enumerate(("2000-01-01 12:00:00", "2000-01-03 00:00:00")) for x in range(3)]
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(100))
    with pytest.raises(Exception, match="HDF5"):
        arrays.read_arrays(spark, str(tmp_path / "h.nc"), ["v"]).count()


def test_netcdf_years(spark, cube, tmp_path):
    d = cube.withColumn("time", F.expr("time + INTERVAL 1 DAY * CAST(temp AS INT) * 10")).withColumn("file", F.concat(F.year("time"), F.lit(".nc")))
    arrays.write_netcdf(d, str(tmp_path), "file", ["time", "cell"], ["rain", "temp"])
    got = arrays.read_arrays(spark, str(tmp_path), ["rain", "temp"], start="2001-01-01", end="2001-12-31", missing="drop")
    assert rows(got) == rows(d.where("year(time) = 2001")) and got.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="missing variables"):
        arrays.read_arrays(spark, str(tmp_path), ["snow"]).count()


def test_times():
    assert arrays.times(np.array([0, 1.5]), "hours since 1969-12-31 23:00").tolist() == [-3_600_000_000, 1_800_000_000]
    assert arrays.times(np.zeros(1), "metres") is None
