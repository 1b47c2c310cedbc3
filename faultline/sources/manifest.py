"""Tables that change by commits: staged files, then one pointer.

A write stages its files under a folder of its own, named by the caller's
``write_id``, and then publishes a snapshot, a short file that lists the writes
of the table. Snapshots are numbered, and a number can be published once only: of two
writers one takes it, the other goes on to the next. Readers open the newest
snapshot, so they see a write whole or not at all, all its tables together.
A write whose id is in the snapshot adds nothing, whatever it carries, so a
retried batch leaves no copies; files of a write that never committed are not seen,
and replaced by its retry. The driver handles names of writes only.

The rename that publishes must not replace a file that exists, as in HDFS and
local file systems; on a store without that, one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        root = self._fs.Path(self.path)
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = root.getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._fs.Path("/".join([self.path, *names]))

    def snapshot(self) -> tuple[int, list[str]]:
        """Number and writes of the newest snapshot; 0 and none before the first."""
        folder = self._at("snapshots")
        if not self._files.exists(folder):
            return 0, []
        found = (re.fullmatch(r"(\d+)\.json", s.getPath().getName()) for s in self._files.listStatus(folder))
        newest = max((int(m[1]) for m in found if m), default=0)
        if not newest:
            return 0, []
        stream = self._files.open(self._at("snapshots", f"{newest}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return newest, json.loads(text)["writes"]

    def _publish(self, number: int, writes: list[str]) -> bool:
        """Whether this writer got the number."""
        draft = self._at("snapshots", f".{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"writes": writes}).encode()))
        finally:
            out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context = self._fs.FileContext.getFileContext(draft.makeQualified(self._files.getUri(), self._files.getWorkingDirectory()).toUri(), self._conf)
            context.rename(draft, self._at("snapshots", f"{number}.json"), options)
            return True
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def write(self, tables: dict[str, DataFrame], write_id: str, partition_by: tuple[str, ...] = ()) -> bool:
        """Stage and commit; False where the write was committed before.

        Rows are dealt by the partition columns and, where a partition is large,
        over as many files as its size asks for.
        """
        if not re.fullmatch(r"[\w.-]+", write_id):
            raise ValueError("a write id is made of letters, digits, '.', '_' and '-'")
        number, writes = self.snapshot()
        if write_id in writes:
            return False
        for name, df in tables.items():
            rows = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
            rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/data/{write_id}/{name}")
        while not self._publish(number + 1, [*writes, write_id]):
            number, writes = self.snapshot()
            if write_id in writes:
                return False
        return True

    def read(self, name: str) -> DataFrame | None:
        """The table as of the newest snapshot; None before the first."""
        _, writes = self.snapshot()
        parts = [self.spark.read.parquet(f"{self.path}/data/{w}/{name}") for w in writes]
        return _united(parts) if parts else None


def _united(parts: list[DataFrame]) -> DataFrame:
    while len(parts) > 1:  # in pairs, so that plans stay shallow
        parts = [a.unionByName(b, allowMissingColumns=True) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]
