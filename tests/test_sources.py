import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from fluvial.operators import skill, splits
from fluvial.sources import config, readers, shapes, sinks
from fluvial.streaming import daily

T = dt.datetime


def test_targets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("agency,site_no,datetime,1_00060_00003,1_00060_00003_cd\n5s,15s,20d,14n,10s\nUSGS,009,2020-01-01,100,A\nUSGS,009,2020-01-02,Ice,P\nUSGS,009,,5,P\n")
    got = readers.read_targets(spark, str(tmp_path / "a.csv")).orderBy("date").collect()
    assert [(r.date, r.QQobs) for r in got] == [(None, pytest.approx(0.14158423296)), (dt.date(2020, 1, 1), pytest.approx(2.8316846592)), (dt.date(2020, 1, 2), None)]
    (tmp_path / "b.csv").write_text("Date,QQobs\n2020-01-01,1.5\n")
    assert readers.read_targets(spark, str(tmp_path / "b.csv"), skip_second_line=False).first().QQobs == 1.5
    for bad in (dict(variables=("x",)), dict(units="furlongs")):
        with pytest.raises((KeyError, ValueError)):
            readers.read_targets(spark, str(tmp_path / "b.csv"), **bad)


def test_gauges_and_basins(spark, tmp_path):
    (tmp_path / "b.txt").write_text("0012\n\n  9A \n")
    assert [r.gauge_id for r in readers.read_basins(spark, str(tmp_path / "b.txt")).collect()] == ["0012", "9A"]
    (tmp_path / "g.csv").write_text("basin_id,lat,lon\n0012,1.5,-3\n")
    (tmp_path / "g.json").write_text('{"gauges": [{"site_no": "0012", "latitude": "1.5"}, {"site_no": "7", "x": 4}]}')
    assert readers.read_gauges(spark, str(tmp_path / "g.csv")).first()[:3] == ("0012", 1.5, -3.0)
    assert [tuple(r) for r in readers.read_gauges(spark, str(tmp_path / "g.json")).orderBy("gauge_id").collect()] == [("0012", 1.5, None, None, None), ("7", None, None, 4.0, None)]


def test_files_by_period(spark, tmp_path):
    for year, day in ((2019, 31), (2020, 1), (2020, 9), (2021, 1)):
        spark.createDataFrame([(year * 100 + day, 1.0)], "flat_index bigint, T2D double").coalesce(1).write.parquet(str(tmp_path / "raw"))
        part = next((tmp_path / "raw").glob("part-*.parquet"))
        (tmp_path / "d" / str(year)).mkdir(parents=True, exist_ok=True)
        part.rename(tmp_path / "d" / str(year) / f"run.{year}01{day:02d}.parquet")
        for f in (tmp_path / "raw").iterdir():
            f.unlink()
        (tmp_path / "raw").rmdir()
    got = readers.read_files(spark, str(tmp_path / "d"), start=T(2020, 1, 1), end=T(2020, 1, 5))
    assert [r.flat_index for r in got.collect()] == [202001]
    assert readers.read_files(spark, str(tmp_path / "d")).count() == 4
    assert readers.list_files(spark, str(tmp_path / "d"), "*.parquet").where("time = '2020-01-09'").count() == 1


def test_open_source_modes(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    times = [T(2019, 12, 31), T(2020, 1, 1), T(2020, 1, 2)]
    df = spark.createDataFrame([(c, t, float(c), 2.0, 9) for c in (1, 2) for t in times], "flat_index bigint, time timestamp_ntz, a double, b double, crs int")
    df.write.parquet(p("one"))
    sinks.write_yearly(df, p("yearly"))
    df.select("flat_index", "time", F.col("a").alias("only")).write.parquet(p("a"))
    df.select("flat_index", "time", "b").write.parquet(p("b"))
    for spec in ({"path": p("one"), "variables": ["a", "b"]}, {"file_mode": "multi_zarr_yearly", "path": p("yearly"), "variables": ["a", "b"]}, {"files": {"a": p("a"), "b": p("b")}}, {"file_mode": "multi_file", "path": p("one"), "variables": ["a", "b"]}):
        got = readers.open_source(spark, spec, start=T(2020, 1, 1), end=T(2020, 1, 1)) if spec.get("file_mode") != "multi_file" else readers.open_source(spark, spec)
        assert set(got.columns) == {"flat_index", "time", "a", "b"}
        assert got.count() == (2 if not spec.get("files") and spec.get("file_mode") != "multi_file" else 6)
    with pytest.raises(KeyError):
        readers.open_source(spark, {"path": p("one"), "variables": ["zz"]})
    s1, s2 = df.groupBy("flat_index").agg(F.first("a").alias("a")), df.where("flat_index = 1").select("flat_index", "b").distinct()
    with pytest.raises(Exception, match="different cells"):
        readers.merge_static([s1, s2]).collect()
    long = readers.wide_to_long(df, ["a", "b"], ["flat_index", "time"])
    assert long.count() == 12 and set(long.columns) == {"flat_index", "time", "variable", "value"}


def test_yearly_modes(spark, tmp_path):
    p = str(tmp_path / "y")
    df = lambda v, *ts: spark.createDataFrame([(1, t, v) for t in ts], "flat_index bigint, time timestamp_ntz, v double")
    sinks.write_yearly(df(1.0, T(2019, 1, 1), T(2020, 1, 1)), p)
    with pytest.raises(Exception, match="exist"):
        sinks.write_yearly(df(2.0, T(2020, 1, 1)), p)
    sinks.write_yearly(df(2.0, T(2020, 1, 1), T(2021, 1, 1)), p, mode="skip")
    sinks.write_yearly(df(3.0, T(2021, 1, 1)), p, mode="overwrite")
    assert {r.year: r.v for r in spark.read.parquet(p).collect()} == {2019: 1.0, 2020: 1.0, 2021: 3.0}
    plan = readers.read_yearly(spark, p, ["v"], T(2020, 1, 1), T(2020, 12, 31))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters", 1)[1][:120]


def test_first_wins(spark):
    a, b = spark.createDataFrame([("x", 2), ("x", 1)], "id string, v int"), spark.createDataFrame([("x", 0), ("y", 5)], "id string, v int")
    assert {r.id: r.v for r in readers.first_wins([a, b], "id").collect()} == {"x": 1, "y": 5}


def test_graph_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"edges": [[0, 1], [1, 2]], "edge_weights": [0.5, 1.5], "outlet_index": [2]}')
    g = readers.read_graph_json(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in g["edges"].orderBy("src").collect()] == [(0, 1, 0.5), (1, 2, 1.5)] and g["nodes"].count() == 3 and g["gauges"].first().node == 2
    sinks.write_graph(g, str(tmp_path / "out"), {"builder": "x", "names": ["a"]})
    back = sinks.read_graph(spark, str(tmp_path / "out"))
    assert back["edges"].exceptAll(g["edges"]).count() == 0 and back["metadata"] == {"builder": "x", "names": ["a"]}
    m = spark.createDataFrame([('{"a": "1"}',), ("plain",)], "j string").select(readers.decode_metadata("j").alias("m")).collect()
    assert m[0].m == {"a": "1"} and m[1].m == {"raw": "plain"}


def test_history_grows_columns(spark, tmp_path):
    p = str(tmp_path / "h")
    sinks.append_history(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), p)
    sinks.append_history(spark.createDataFrame([(2, 0.4, 0.7)], "epoch int, loss double, kge double"), p)
    assert [(r.epoch, r.kge) for r in sinks.read_history(spark, p).orderBy("epoch").collect()] == [(1, None), (2, 0.7)]


def _shp(parts, kind=3):
    points = [p for part in parts for p in part]
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    body = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
    return struct.pack(">ii", 1, len(body) // 2) + body


def test_shapefile(spark, tmp_path):
    (tmp_path / "r.shp").write_bytes(b"\0" * 100 + _shp([[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 6.0)]]) + _shp([[(0.0, 0.0)]], 1))
    fields = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in (("COMID", "N", 6), ("FLOWDIR", "C", 12)))
    rows = b" " + b"    12" + b"Against flow" + b"*" + b"    13" + b"With        "
    (tmp_path / "r.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, 2, 32 + len(fields) + 1, 19) + fields + b"\r" + rows)
    got = shapes.read_shapefile(spark, str(tmp_path)).withColumn("against", shapes.against_flow()).orderBy("part").collect()
    assert [(r.part, [tuple(p) for p in r.points], r.attributes["COMID"], r.against) for r in got] == [(0, [(0, 0), (1, 1)], "12", True), (1, [(5, 5), (6, 6)], "12", True)]
    assert shapes.read_attributes(spark, str(tmp_path)).where("record = 2").first().attributes == {}


def _layer_files(folder, n, index=True):
    """A layer of n lines of which the k-th has k % 7 + 2 points, each third a point shape, and its table, each fifth row deleted."""
    rng, at, shp, shx, rows = random.Random(n), 100, b"", b"", b""
    lines = {}
    for k in range(1, n + 1):
        points = [(rng.random(), rng.random()) for _ in range(k % 7 + 2)]
        record = struct.pack(">i", k) + (_shp([points[:1]], 1) if k % 3 == 0 else _shp([points[:2], points[2:]] if len(points) > 3 else [points]))[4:]
        if k % 3:
            lines[k] = [points[:2], points[2:]] if len(points) > 3 else [points]
        shx += struct.pack(">ii", at // 2, len(record) // 2 - 4)
        shp, at = shp + record, at + len(record)
        rows += (b"*" if k % 5 == 0 else b" ") + f"{k:6d}".encode()
    field = b"ID".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    (folder / "a layer%.shp").write_bytes(b"\0" * 100 + shp)
    if index:
        (folder / "a layer%.shx").write_bytes(b"\0" * 100 + (shx if index is True else index(shx)))
    (folder / "a layer%.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, n, 65, 7) + field + b"\r" + rows)
    return lines


def _swapped(shx):
    return shx[8:16] + shx[:8] + shx[16:]


@pytest.mark.parametrize("index, pieces", [(True, 8), (False, 1), (_swapped, 1), (lambda shx: shx[:-8] + b"\x7f" + shx[-7:], 1), (lambda shx: b"", 1)])
def test_shapefile_in_pieces(spark, tmp_path, monkeypatch, index, pieces):
    """Every record once, however a file is cut; reads and batches are small."""
    lines = _layer_files(tmp_path, 200, index)
    for name, value in (("BLOCK", 700), ("ENTRIES", 9), ("OUT", 50)):
        monkeypatch.setattr(shapes, name, value)
    cut = shapes.shape_pieces(str(tmp_path / "a layer%.shp"), (tmp_path / "a layer%.shp").stat().st_size, 3000)
    assert len(cut) >= pieces and (pieces > 1 or len(cut) == 1) and cut[0][0] == 100 and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
    assert all(size <= 3000 + 300 for *_, size in cut[: len(cut) * (pieces > 1)])
    got = shapes.read_shapefile(spark, str(tmp_path), piece=3000).collect()
    assert sorted((r.record, r.part, [tuple(p) for p in r.points], (r.attributes or {}).get("ID")) for r in got) == sorted((k, j, part, None if k % 5 == 0 else str(k)) for k, parts in lines.items() for j, part in enumerate(parts))
    rows = shapes.read_attributes(spark, str(tmp_path), piece=100)
    assert sorted((r.record, r.attributes.get("ID")) for r in rows.collect()) == [(k, None if k % 5 == 0 else str(k)) for k in range(1, 201)]
    assert len(shapes.table_pieces(str(tmp_path / "a layer%.dbf"), (tmp_path / "a layer%.dbf").stat().st_size, 100)) == 15


def test_shapefile_bounds(spark, tmp_path):
    """What a task reads at once is a block, whatever the file's length; a truncated file ends with its last whole record."""
    _layer_files(tmp_path, 500)
    path = tmp_path / "a layer%.shp"

    class Counting:
        def __init__(self, f):
            self.f, self.most = f, 0

        def seek(self, k):
            self.f.seek(k)

        def read(self, n):
            self.most = max(self.most, n)
            return self.f.read(n)

    with open(path, "rb") as f:
        counting, block = Counting(f), shapes.BLOCK
        shapes.BLOCK = 512
        try:
            assert len(list(shapes.shapes_of(counting, 100, path.stat().st_size))) == 334
        finally:
            shapes.BLOCK = block
        assert counting.most <= 512
    path.write_bytes(path.read_bytes()[:-1])
    (tmp_path / "a layer%.dbf").write_bytes((tmp_path / "a layer%.dbf").read_bytes()[:-1])
    assert shapes.read_lines(spark, str(tmp_path), piece=5000).select("record").distinct().count() == 333
    assert shapes.read_attributes(spark, str(tmp_path), piece=500).count() == 499
    for name in ("a layer%.shp", "a layer%.dbf"):
        (tmp_path / name).write_bytes(b"")
    assert shapes.read_shapefile(spark, str(tmp_path)).count() == 0


GOOD = {k: "x" for k in config.REQUIRED} | {"forcing": {"variables": ["a"]}, "static": {}, "targets": {"variables": ["q"]}, "windowing": {"sequence_days": 180}}


@pytest.mark.parametrize("change, message", [({"data_dir": None}, "data_dir"), ({"forcing": {}}, "forcing.variables"), ({"windowing": {}}, "window"), ({"windowing": {"sequence_days": 1, "sequence_years": 1}}, "exclude"), ({"windowing": {"sequence_days": -1}}, "positive"), ({"io_mode": "x"}, "io_mode"), ({"training": {"weight_decay": -1}}, "negative"), ({"curriculum": {"stages": [{"epochs": 0}]}}, "stage 1"), ({"curriculum": {"gauge_weights": {"a": 0}}}, "gauge"), ({"runoff_transfer": {"weight_strategy": "magic"}}, "weight_strategy"), ({"routing": {"graph": {"builder": "flowlines"}}}, "flowlines"), ({"runoff_model": {"warmup_days": 1, "lstm_warmup_days": 2}}, "differ")])
def test_config_rules(change, message):
    with pytest.raises(ValueError, match=message):
        config.validate({**GOOD, **change})


def test_config(tmp_path):
    assert config.validate(GOOD)["windowing"]
    sinks.write_yaml(GOOD, str(tmp_path / "c.yml"))
    assert config.load(str(tmp_path / "c.yml")) == GOOD
    assert config.learning_rates({"training": {"learning_rate": 1.0}, "curriculum": {"stage_learning_rate_decay": 0.5, "stages": [{}, {}, {"learning_rate": 9}]}}) == [1.0, 0.5, 9.0]


def test_scaler_and_split_files(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "new folder" / "s.yml")
    sinks.write_yaml({"q": {"mean": 1, "std": "2.5"}}, p)
    assert [tuple(r) for r in sinks.read_scaler(spark, p).collect()] == [("q", 1.0, 2.5)]
    for bad in ({"mean": 1}, {"mean": "x", "std": 1}, {"mean": float("nan"), "std": 1}, 3, None):
        sinks.write_yaml({"q": bad}, p)
        with pytest.raises(ValueError, match="mean and a std"):
            sinks.read_scaler(spark, p)
    sinks.write_yaml({}, p)
    assert sinks.read_scaler(spark, p).count() == 0
    blocks = spark.createDataFrame([(2, dt.date(2001, 1, 1), dt.date(2001, 2, 1), "val"), (1, dt.date(2000, 1, 1), dt.date(2000, 2, 1), "train")], "block_id int, block_start date, block_end date, period string")
    sinks.write_split(blocks, p, {"seed": 1})
    assert sinks.read_yaml(p)["metadata"] == {"seed": 1, "assignment_summary": {"train": 1, "val": 1}}
    assert [b["block_id"] for b in sinks.read_yaml(p)["blocks"]] == [1, 2]
    assert [tuple(r) for r in splits.load_blocks(sinks.read_split(spark, p), "validation").collect()] == [(2, dt.date(2001, 1, 1), dt.date(2001, 2, 1), "validation")]
    sinks.write_yaml({"blocks": [{"start": "2000-01-01", "end": "2000-01-09 12:00:00", "period": "test"}, {"id": 7, "start": "x", "period": "train"}]}, p)
    assert [tuple(r)[:1] for r in sinks.read_split(spark, p).collect()] == [(0,), (7,)]
    with pytest.raises(Exception, match="invalid block 7"):
        splits.load_blocks(sinks.read_split(spark, p), "train").collect()
    with pytest.raises(FileNotFoundError):
        sinks.read_yaml(str(tmp_path / "none.yml"))
    monkeypatch.setattr(sinks, "SPLIT_BLOCKS", 1)
    with pytest.raises(ValueError, match="at most"):
        sinks.write_split(blocks, p)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(c, T(2020, 1, d, h), float(d * h)) for c in (1, 2) for d in (1, 2, 9) for h in (0, 6)]
    spark.createDataFrame(rows, "cell int, time timestamp_ntz, value double").write.parquet(src)
    stream = spark.readStream.schema("cell int, time timestamp_ntz, value double").parquet(src)
    daily.run_once(daily.daily_stream(stream, ["cell"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    daily.run_once(daily.daily_stream(stream, ["cell"]), str(tmp_path / "all"), str(tmp_path / "cp2"), "complete")
    done, every = spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "all"))
    assert every.count() == 6 and done.where("date < '2020-01-08'").count() == 4 and done.exceptAll(every).count() == 0
    assert every.where("cell = 1 AND date = '2020-01-02'").first()[2:] == (2, 12.0, 6.0, 0.0, 12.0)
    pairs = spark.createDataFrame([("g", float(k), k * 1.1 + 1) for k in range(8)] + [("g", None, 1.0)], "g string, prediction double, observation double")
    pairs.write.parquet(str(tmp_path / "pairs"))
    s = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "pairs"))
    daily.run_once(daily.moment_stream(s, ["g"]), str(tmp_path / "m"), str(tmp_path / "cp3"), "complete")
    a = skill.metrics_from_moments(spark.read.parquet(str(tmp_path / "m")), ["g"]).first()
    b = skill.metrics_from_moments(skill.moments(pairs, ["g"]), ["g"]).first()
    assert a.n == 8 and a.kge == pytest.approx(b.kge)


def test_sqlite_and_rivers(spark, tmp_path):
    import sqlite3

    con = sqlite3.connect(tmp_path / "a.gpkg")
    con.execute("CREATE TABLE attrs (id TEXT, slope REAL, geom BLOB)")
    con.execute("INSERT INTO attrs VALUES ('wb-1', 0.5, x'00'), ('wb-2', NULL, NULL)")
    con.commit()
    con.close()
    (tmp_path / "b.gpkg").write_bytes(b"not a database")
    rows = readers.read_sqlite(spark, str(tmp_path), "attrs").collect()
    assert sorted((r.attributes["id"], r.attributes["slope"]) for r in rows) == [("wb-1", "0.5"), ("wb-2", None)]
    st = spark.createDataFrame([("g", 1), ("h", 2)], "gauge_id string, comid int")
    flow = spark.createDataFrame([(1, T(2020, 1, 1, h), float(h)) for h in (0, 6)] + [(9, T(2020, 1, 1), 1.0)], "comid int, time timestamp_ntz, value double")
    assert [tuple(r) for r in readers.river_series(flow, st).collect()] == [("g", 1, dt.date(2020, 1, 1), 3.0)]
    named = readers.river_ids(st.select("gauge_id"), ("cache", st.where("gauge_id = 'g'")), ("near", spark.createDataFrame([("g", 7), ("h", 8)], "gauge_id string, comid int")))
    assert sorted(tuple(r) for r in named.collect()) == [("g", 1, "cache"), ("h", 8, "near")]
