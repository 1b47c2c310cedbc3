"""CSV over small blocks against the csv module."""

import csv
import random

import pytest

from faultline.sources import logs, quoted


def plain(path):
    with open(path, newline="") as f:
        reader = csv.DictReader(f)
        return [(n, {k: v for k, v in r.items() if k is not None}) for n, r in enumerate(reader, start=2)]


@pytest.fixture
def small_blocks(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.set(key, before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, rng, names, n, wild):
    cell = ["", "a", "x y", "7", "é", "b,c", "line\nbreak", 'say "hi"', "two\n\nbreaks, and \"quotes\"", "\n", "5\" disk" if wild else "5 disk"]
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(names)
        for _ in range(n):
            out.writerow([rng.choice(cell) for _ in range(len(names) + rng.choice([0, 0, 0, -1, 1]))])
            if wild and rng.random() < 0.2:
                f.write(rng.choice(["\n", 'mid"quote,"closed" tail,z\n', ',,\n', '"",x\n', '"a""b",\n']))


def test_rows_equal_the_csv_module(small_blocks, tmp_path):
    rng = random.Random(12)
    files = {}
    for k, (names, n) in enumerate([(["ts", "msg", "level"], 400), (["a b", "c"], 90), (["only"], 30), (["h1", "h2"], 0), (["m", "n", "m"], 20)]):
        path = tmp_path / f"f{k}.csv"
        write(path, rng, names, n, wild=True)
        files[path.name] = plain(path)
    (tmp_path / "open.csv").write_text('x,y\n1,2\n"never closed, 3\n4,5')
    files["open.csv"] = plain(tmp_path / "open.csv")
    (tmp_path / "empty.csv").write_text("")
    files["empty.csv"] = []
    spark = small_blocks
    assert spark.read.text(str(tmp_path / "f0.csv")).rdd.getNumPartitions() > 8
    got = {name: [] for name in files}
    for r in quoted.rows(spark, str(tmp_path)).collect():
        got[r["file"].rsplit("/", 1)[1]].append((r["line_number"], r["data"]))
    for name, want in files.items():
        assert sorted(got[name], key=lambda r: r[0]) == want, name


def test_scan_takes_files_of_different_headers(small_blocks, tmp_path):
    (tmp_path / "a.csv").write_text('time,msg,level\n2026-01-01T00:00:00Z,"disk\nfull",error\n , ,\n')
    (tmp_path / "b.csv").write_text("level,message\nwarn,slow\n")
    got = logs.scan_logs(small_blocks, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], line_numbers=True)
    rows = sorted((r["message"], r["severity"], r["line_number"]) for r in got.collect())
    assert rows == [("disk\nfull", "HIGH", 2), ("slow", "MEDIUM", 2)]
