"""Slices of equal depth against plain windows and loops, with a dense hour and a long series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import anomaly
from faultline.operators.asof import asof_forward
from faultline.operators.slices import equal_slices, grid_pairs

BASE = dt.datetime(2026, 9, 1, 12)
SCHEMA = "metric_name string, timestamp timestamp, id bigint, value double"


@pytest.fixture(scope="module")
def points(spark):
    """One long series with most of its points in one hour, a middling one, short ones, one without a name."""
    rng = random.Random(6)
    rows = [("long", BASE + dt.timedelta(seconds=rng.randint(0, 3600)), i, float(rng.randint(1, 9))) for i in range(3000)]
    rows += [("long", BASE + dt.timedelta(hours=rng.randint(-500, 500)), i, float(rng.randint(1, 9))) for i in range(3000, 3400)]
    rows += [("middling", BASE + dt.timedelta(minutes=i), 5000 + i, float(i % 7)) for i in range(400)]
    rows += [(f"short{i % 9}", BASE + dt.timedelta(minutes=i), 6000 + i, 1.0) for i in range(90)]
    rows += [(None, BASE + dt.timedelta(minutes=i // 2), 7000 + i, float(i % 5)) for i in range(300)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("rows", [50, 130, 3399])
def test_slices_follow_time_and_are_even(points, rows):
    sliced, many = equal_slices(points, ["metric_name"], "timestamp", rows)
    assert many and sliced.columns == [*points.columns, "_slice"] and sliced.count() == points.count()
    spans = sliced.groupBy("metric_name", "_slice").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n")).collect()
    by = {}
    for r in sorted(spans, key=lambda r: (r["metric_name"] or "", r["_slice"])):
        assert r["n"] <= 1.2 * rows + 5  # rows of one second stay together
        if r["metric_name"] in by:
            assert by[r["metric_name"]] < r["a"]
        by[r["metric_name"]] = r["b"]
    assert {r["metric_name"] for r in spans if r["_slice"] == 0} == set(by)
    assert max(r["_slice"] for r in spans if (r["metric_name"] or "").startswith("short")) == 0


def test_short_series_are_not_sliced(points):
    sliced, many = equal_slices(points, ["metric_name"], "timestamp", 3400)
    assert not many and sliced.where("_slice != 0").isEmpty()
    sliced, many = equal_slices(points.limit(0), ["metric_name"], "timestamp", 10)
    assert not many and sliced.isEmpty()


def test_rolling_statistics_with_a_dense_hour(points):
    names = ["metric_name", "id", "n_window", "mean", "stddev", "minimum", "maximum", "pct_change", "pct_rank"]

    def run(**kw):
        out = anomaly.rolling_stats(points, **kw).select(*names).collect()
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out), key=str)

    plain = run()
    assert plain == run(slice_rows=60) == run(slice_rows=700) == run(slice_us=3_600_000_000)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("rows", [7, 40])
def test_asof_over_slices_equals_loop(spark, strict, rows):
    rng = random.Random(8)
    data = [(rng.choice(["k", "k", "k", None]), i, BASE + dt.timedelta(seconds=rng.choice([rng.randint(0, 90), rng.randint(0, 9000)])), i % 3) for i in range(260)]
    df = spark.createDataFrame(data, "k string, id long, timestamp timestamp, role int")
    got = asof_forward(df.filter("role < 2"), df.filter("role > 0"), ["k"], 600_000_000, strict, 0.0, slice_rows=rows)
    got = {r["source_id"]: r["target_id"] for r in got.collect()}
    want = {}
    for k, sid, at, role in data:
        ahead = [
            (t, i) for q, i, t, r in data
            if q == k and r > 0 and i != sid and (t > at if strict else t >= at) and t - at <= dt.timedelta(seconds=600)
        ]
        if role < 2 and ahead:
            want[sid] = min(ahead)[1]
    assert got == want


@pytest.mark.parametrize("broadcast_keys", [20_000, 1])
def test_grid_pairs_never_broadcasts_rows(spark, tmp_path, monkeypatch, broadcast_keys):
    """Small files of rows that explode: all pairs, and no broadcast but that of the cells."""
    monkeypatch.setattr("faultline.operators.slices.BROADCAST_KEYS", broadcast_keys, raising=False)
    spark.range(300).selectExpr("id as l", "id % 3 as k").write.parquet(f"{tmp_path}/l")
    spark.range(90).selectExpr("id as r", "id % 4 as k").write.parquet(f"{tmp_path}/r")
    left = spark.read.parquet(f"{tmp_path}/l").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4))))
    out = grid_pairs(left, spark.read.parquet(f"{tmp_path}/r"), ["k"], "l", "r", F.col("l") != F.col("r"), pairs_per_task=500)
    got = sorted((x["l"], x["copy"], x["r"]) for x in out.collect())
    assert got == sorted((a, c, b) for a in range(300) for c in range(1, 5) for b in range(90) if a % 3 == b % 4 and a != b)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    rows = plan.count("BroadcastHashJoin") - (2 if broadcast_keys > 1 else 0)
    assert rows <= 0 and "SortMergeJoin" in plan
