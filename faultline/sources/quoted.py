"""CSV records over splittable files.

A quoted cell may hold line breaks, so a task that starts within a file does not
know whether it stands inside quotes. Each line is therefore taken as a
function: how it ends when it starts outside quotes, and how when inside. These
functions compose: first within a block of a file, then over the blocks' results,
one row each, and so every line learns its start. A file is read by as many
tasks as it has blocks; only lines of records that span several are grouped.

Line breaks inside cells come back as ``\\n``. A quote opens a cell only at its
start, as in the usual readers; an unclosed cell reaches to the end of its file, less
the last line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CELL = r'"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+'
_WHOLE = rf"(?s)^(?:,(?:{_CELL}))*+$"  # a line behind a comma: closed cells only
_LEAVES = rf'(?s)^(?:[^"]|"")*+"[^,]*+(?:,(?:{_CELL}))*+$'  # from inside quotes to outside
_ANY = rf'(?s),({_CELL}|"(?:[^"]|"")*+$)'
_PARTS = r'(?s)^"((?:[^"]|"")*+)"?(.*)$'


def _composed(df: DataFrame, keys: list[str], order: str, closed: Column, opened: Column) -> DataFrame:
    """Add ``_set``, ``_to``: the composition of the functions up to and with each row of ``keys``.

    ``closed`` and ``opened`` tell whether a row ends inside quotes when it starts
    outside or inside. With ``_set`` the state after is ``_to`` whatever it was before,
    else it is that before, turned over if ``_to``.
    """
    d = df.withColumns({"_c": closed == opened, "_turn": (closed & ~opened).cast("int"), "_end": closed})
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_turns", F.sum(F.when(F.col("_c"), 0).otherwise(F.col("_turn"))).over(upto))
    last = F.last(F.when(F.col("_c"), F.struct(F.col("_end").alias("end"), F.col("_turns").alias("turns"))), True).over(upto)
    d = d.withColumn("_last", last)
    since = (F.col("_turns") - F.coalesce("_last.turns", F.lit(0))) % 2 == 1
    fixed = F.col("_last").isNotNull()
    return d.withColumns({"_set": fixed, "_to": F.when(fixed, F.col("_last.end") != since).otherwise(since)}).drop("_c", "_turn", "_end", "_turns", "_last")


def _after(state: Column) -> Column:
    return F.when(F.col("_set"), F.col("_to")).otherwise(state != F.col("_to"))


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, record, text): the records of each file, numbered from 1; blank lines are none."""
    lines = spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    quoted = F.contains("line", F.lit('"'))
    closed = quoted & ~F.concat(F.lit(","), "line").rlike(_WHOLE)
    opened = ~quoted | ~F.col("line").rlike(_LEAVES)
    own = _composed(lines.withColumns({"_f0": closed, "_f1": opened}), ["file", "_block"], "_at", F.col("_f0"), F.col("_f1"))
    ends = own.groupBy("file", "_block").agg(F.max_by(F.struct("_set", "_to"), "_at").alias("_e"))
    ends = _composed(
        ends.select("file", "_block", F.col("_e._set").alias("_s"), F.col("_e._to").alias("_t")),
        ["file"],
        "_block",
        F.col("_t"),  # from outside: the value, or whether it turns
        F.when(F.col("_s"), F.col("_t")).otherwise(~F.col("_t")),
    )
    by_block = Window.partitionBy("file").orderBy("_block")
    starts = ends.withColumn("_open", F.lag(_after(F.lit(False))).over(by_block))
    starts = starts.select("file", "_block", F.coalesce("_open", F.lit(False)).alias("_inside"))
    in_block = Window.partitionBy("file", "_block").orderBy("_at")
    d = own.join(starts, ["file", "_block"])
    d = d.withColumn("_end", _after(F.col("_inside")))
    d = d.withColumn("_begin", F.coalesce(F.lag("_end").over(in_block), F.col("_inside")))
    first = (~F.col("_begin") & (F.col("line") != "")).cast("long")
    d = d.withColumn("_n", F.sum(first).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    counts = d.groupBy("file", "_block").agg(F.max("_n").alias("_m"))
    before = F.sum("_m").over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("file", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    d = d.join(counts, ["file", "_block"]).withColumn("record", F.col("_before") + F.col("_n"))
    alone = ~F.col("_begin") & ~F.col("_end")
    single = d.where(alone & (F.col("line") != "")).select("file", "record", F.col("line").alias("text"))
    body = F.array_sort(F.collect_list(F.struct("_block", "_at", "line")))  # one record's lines
    several = d.where(~alone).groupBy("file", "record").agg(F.array_join(body["line"], "\n").alias("text"))
    return single.unionByName(several)


def cells(text: Column) -> Column:
    """The cells of a record."""
    found = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(_ANY), F.lit(1))

    def plain(cell: Column) -> Column:
        inner = F.replace(F.regexp_extract(cell, _PARTS, 1), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(cell, F.lit('"')), F.concat(inner, F.regexp_extract(cell, _PARTS, 2))).otherwise(cell)

    return F.transform(found, plain)


def rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_number, data): each file's rows by its own header; rows count from 2.

    Cells that a row lacks are null, those beyond the header are dropped; of
    columns with one name the last counts.
    """
    d = records(spark, paths).withColumn("_cells", cells(F.col("text")))
    heads = d.where("record = 1").select("file", F.col("_cells").alias("_names"))
    data = F.map_from_arrays("_names", F.transform("_names", lambda n, i: F.get("_cells", i)))
    d = d.where("record > 1").join(heads, "file")
    return d.select("file", F.col("record").alias("line_number"), data.alias("data"))
