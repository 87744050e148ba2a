"""Rules that are observed while tables are written."""

import os

import pytest
from pyspark.sql import functions as F

from fluvial.operators import checks


def test_rules_are_counted_in_the_pass_that_writes(spark, tmp_path):
    d = spark.range(100).withColumn("extra", F.col("id") % 7)
    got = checks.write_checked(d, f"{tmp_path}/a", {"sevens": F.col("extra") == 0, "none": F.col("id") < 0, "null": F.lit(None).cast("boolean")}, ["id"], "id", strict=False)
    assert got == {"rows": 100, "sevens": 15, "none": 0, "null": 0, "example": "0"} and spark.read.parquet(f"{tmp_path}/a").columns == ["id"]
    with pytest.raises(checks.RulesBroken, match="'big': 1.*id 99"):
        checks.write_checked(d, f"{tmp_path}/b", {"big": F.col("id") > 98}, example="id")
    assert not os.path.exists(f"{tmp_path}/b")


def test_alignment(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "t int, v string")
    right = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "t int, w int")
    assert checks.aligned(left, right, ["t"], f"{tmp_path}/a")["rows"] == 3
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/a").collect()} == {(1, "a", 10), (2, "b", 20), (3, "c", 30)}
    with pytest.raises(checks.RulesBroken, match="'unmatched': 1"):
        checks.aligned(left, right.where("t <> 2"), ["t"], f"{tmp_path}/b")
    with pytest.raises(checks.RulesBroken, match="'ambiguous': 1"):
        checks.aligned(left, right.union(right.where("t = 1")), ["t"], f"{tmp_path}/c")


def test_graph_rules(spark, tmp_path):
    t = {
        "nodes": spark.createDataFrame([(0,), (1,), (2,), (2,)], "node bigint"), "edges": spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0), (1, 9, None), (2, 0, float("inf"))], "src bigint, dst bigint, weight double"),
        "gauges": spark.createDataFrame([(2,), (7,)], "node bigint"), "sources": spark.createDataFrame([(5, 0, 0.5)], "source bigint, target bigint, weight double"),
    }
    got = checks.write_graph_checked(t, f"{tmp_path}/g", strict=False)
    assert got["nodes"] == {"rows": 4, "node missing": 0, "node twice": 2, "node out of range": 0}
    assert got["edges"] == {"rows": 4, "src without a node": 0, "dst without a node": 1, "weight not finite": 2, "loop": 1}
    assert got["gauges"]["node without a node"] == 1 and got["sources"] == {"rows": 1, "target without a node": 0, "weight not finite": 0}
    with pytest.raises(checks.RulesBroken):
        checks.write_graph_checked(t, f"{tmp_path}/h")
