"""A manifest that only reads what is new, in batches and as a stream."""

import os
import time

import pytest

from fluvial.sources import manifest


def put(spark, folder, name, days):
    rows = [(f"2020-01-{d:02d} 00:00:00",) for d in days]
    spark.createDataFrame(rows, "t string").selectExpr("CAST(t AS TIMESTAMP_NTZ) AS time").coalesce(1).write.parquet(f"{folder}/tmp")
    part = next(f for f in os.listdir(f"{folder}/tmp") if f.endswith(".parquet"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.replace(f"{folder}/tmp/{part}", f"{folder}/in/{name}")
    for f in os.listdir(f"{folder}/tmp"):
        os.remove(f"{folder}/tmp/{f}")
    os.rmdir(f"{folder}/tmp")


def rows(spark, folder, path):
    return {os.path.basename(r.path): (str(r.start_time)[:10], str(r.end_time)[:10], r.n_steps, r.step_seconds) for r in manifest.current(spark, f"{folder}/in", path).collect()}


def test_only_new_and_changed_files_are_read(spark, tmp_path, monkeypatch):
    folder, path = str(tmp_path), f"{tmp_path}/manifest"
    read = []
    described = manifest.described
    monkeypatch.setattr(manifest, "described", lambda files, time="time": (read.append(sorted(os.path.basename(r.path) for r in files.collect())), described(files, time))[1])
    put(spark, folder, "a b.parquet", (1, 2, 4))
    put(spark, folder, "b.parquet", (5,))
    assert manifest.update(spark, f"{folder}/in", path) == 2 and manifest.update(spark, f"{folder}/in", path) == 0
    assert rows(spark, folder, path) == {"a b.parquet": ("2020-01-01", "2020-01-04", 3, 129600.0), "b.parquet": ("2020-01-05", "2020-01-05", 1, None)}
    time.sleep(1.1)
    put(spark, folder, "b.parquet", (5, 6))
    put(spark, folder, "run.2021020300.parquet", ())
    os.remove(f"{folder}/in/a b.parquet")
    assert manifest.update(spark, f"{folder}/in", path) == 2
    assert [r for r in read if r] == [["a b.parquet", "b.parquet"], ["b.parquet", "run.2021020300.parquet"]]
    assert rows(spark, folder, path) == {"b.parquet": ("2020-01-05", "2020-01-06", 2, 86400.0), "run.2021020300.parquet": ("2021-02-03", "2021-02-03", 1, None)}
    spark.range(1).write.parquet(f"{folder}/other")
    with pytest.raises(ValueError, match="no manifest"):
        manifest.load(spark, f"{folder}/other")


def test_stream_of_files(spark, tmp_path):
    folder, path = str(tmp_path), f"{tmp_path}/manifest"
    for name, days in (("a.parquet", (1, 2)), ("b.parquet", (3,))):
        put(spark, folder, name, days)
        manifest.stream(spark, f"{folder}/in", path, f"{folder}/checkpoint")
    assert rows(spark, folder, path) == {"a.parquet": ("2020-01-01", "2020-01-02", 2, 86400.0), "b.parquet": ("2020-01-03", "2020-01-03", 1, None)}
