"""Files that queries write for scans and streams follow the splits of their table."""

import glob

import pytest

import catalog.sources_q as SQ  # registers the queries
from catalog import QUERIES

SPLITS = 20


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    d = spark.range(200).selectExpr(
        "id as doc_id", "concat('first ', id, '\\nsecond \"', id, '\"') as text", "'en' as lang", "'web' as source", "20L as n_chars"
    )
    d.repartition(SPLITS).write.parquet(f"{folder}/documents.parquet")
    spark.range(4).selectExpr("id as item_id", "'a b\\nc d\\ne f' as text").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize(
    "name, pattern, rows",
    [("s5_scan_csv_documents", "csv-*/*.csv", 200), ("s7_scan_logs", "mixed-*/a/*.txt", 2), ("t1_stream_ingest", "logs-*/*.txt", 200), ("t3_stream_error_groups", "input-*/*.parquet", None)],
)
def test_files_grow_with_the_table(spark, tables, tmp_path, monkeypatch, name, pattern, rows):
    monkeypatch.setattr(SQ, "shared_path", lambda _, x: f"{tmp_path}/{x}-0")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")  # about a file a split
    spark.conf.set("spark.sql.files.openCostInBytes", "8000")
    try:
        n = len(QUERIES[name](spark, tables).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert rows is None or n == rows
    assert len(glob.glob(f"{tmp_path}/{pattern}")) >= SPLITS
