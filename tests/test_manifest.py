"""Commits: retries, writers that race, files that never committed."""

import datetime as dt

import pytest

from faultline.sources import events
from faultline.sources.manifest import Table


def test_writes_appear_whole_and_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    assert table.read("a") is None and table.snapshot() == (0, [])
    one, two = spark.range(10), spark.range(10, 15).selectExpr("id", "id % 2 as half")
    assert table.write({"a": one, "b": one}, "w1")
    assert table.write({"a": two, "b": two}, "w2", ("half",))
    assert not table.write({"a": spark.range(99), "b": one}, "w1")
    assert sorted(r["id"] for r in table.read("a").collect()) == list(range(15))
    assert table.snapshot() == (2, ["w1", "w2"])
    with pytest.raises(ValueError):
        table.write({"a": one}, "../w3")


def test_staged_files_are_not_seen_and_a_retry_replaces_them(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.write({"a": spark.range(3)}, "w1")
    spark.range(50).write.parquet(str(tmp_path / "t/data/w2/a"))  # a writer that died before its commit
    assert table.read("a").count() == 3
    assert table.write({"a": spark.range(3, 7)}, "w2")
    assert table.read("a").count() == 7


def test_a_taken_number_is_not_published_again(spark, tmp_path):
    mine, other = (Table(spark, str(tmp_path / "t")) for _ in range(2))
    mine.write({"a": spark.range(1)}, "w1")
    assert not mine._publish(1, ["lost"])
    real = mine._publish

    def late(number, writes):  # another writer commits just before
        mine._publish = real
        other.write({"a": spark.range(5, 9)}, "theirs")
        return real(number, writes)

    mine._publish = late
    assert mine.write({"a": spark.range(2, 4)}, "w2")
    assert mine.snapshot() == (3, ["w1", "theirs", "w2"])
    assert mine.read("a").count() == 7


def test_latest_evidence_of_each_incident(spark, tmp_path):
    path = str(tmp_path / "e")

    def write(ids, day, name):
        rows = spark.createDataFrame([(i, f"{name}-{i}") for i in ids], "incident_id long, key string")
        return events.write_evidence(rows, rows, rows.select("incident_id"), path, dt.datetime(2026, 1, day), name)

    assert write([1, 2, 3], 1, "a") and write([2, 3], 2, "b") and not write([1, 2, 3], 5, "a")
    got = events.latest_evidence(spark, path, spark.createDataFrame([(1,), (2,)], "incident_id long"))
    assert sorted(r["key"] for r in got["items"].collect()) == ["a-1", "b-2"]
    assert got["groups"].count() == 2 and got["relations"].count() == 2
