"""Rank correlation of groups of any size by counting inversions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from faultline.session import cut

SLICE_ROWS = 65_536
_ROW_BITS = 33  # monotonically_increasing_id holds the partition above these


def inversions(starts: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per segment: weight of the pairs whose earlier row has the higher ``rank``.

    ``starts`` are the offsets at which segments begin; ranks of a segment differ.
    Halves of blocks of 2, 4, 8... rows are merged in all segments at once.
    """
    n = len(rank)
    lengths = np.diff(np.append(starts, n))
    first = np.repeat(starts, lengths)
    place = np.arange(n) - first
    by_rank = np.lexsort((rank, first))
    found = np.zeros(n, np.int64)
    for level in range(int(lengths.max() - 1).bit_length()):
        block = first + (place >> (level + 1))  # differs between segments, as they hold fewer blocks than rows
        order = by_rank[np.argsort(block[by_rank], kind="stable")]
        of = block[order]
        left = (place[order] >> level) & 1 == 0
        seen = np.cumsum(np.where(left, weight[order], 0))
        last = np.searchsorted(of, of, side="right") - 1
        found += np.where(left, 0, weight[order] * (seen[last] - seen))
    return np.add.reduceat(found, starts)


def _counts(keys: Sequence[str]):
    """Inversions of the runs of equal keys and ``_part`` in rows sorted by them; a run may span batches."""
    names = [*keys, "_part"]

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        new = _changes(rows, names)
        starts = np.flatnonzero(new)
        out = rows.iloc[starts][list(keys)].reset_index(drop=True)
        out["_d"] = inversions(starts, rows["_rank"].to_numpy(np.int64), rows["_w"].to_numpy(np.int64))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            inner = np.flatnonzero(_changes(batch, names))
            at = int(inner[-1])
            if at == 0 and kept and not _changes(pd.concat([kept[-1].tail(1), batch.head(1)]), names)[1]:
                kept.append(batch)  # the open run goes on
                continue
            if kept or at:
                yield count(pd.concat([*kept, batch.iloc[:at]], ignore_index=True))
            kept = [batch.iloc[at:]]
        if kept:
            yield count(pd.concat(kept, ignore_index=True))

    return run


def _changes(rows: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Whether each row differs in ``names`` from the one before it; the first one does."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for name in names:
        c = rows[name].reset_index(drop=True)
        before, missing = c.shift(), c.isna()
        same = (c == before).fillna(False).to_numpy(bool) | (missing & missing.shift(fill_value=False)).to_numpy(bool)
        new[1:] |= ~same[1:]
    return new


def _pairs(n: str) -> Column:
    return F.expr(f"{n} * ({n} - 1) div 2")


def _between(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inversions between rows that differ in slice and in bin, by running sums over the whole table of both."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    grid = cells.select(*keys, "_slice").distinct().alias("l").join(cells.select(*keys, "_bin").distinct().alias("r"), same or F.lit(True))
    zero = grid.select("l.*", "r._bin", F.lit(0).cast("bigint").alias("_w"))
    full = cells.unionByName(zero).groupBy(*keys, "_slice", "_bin").agg(F.sum("_w").alias("_w"))
    earlier = Window.partitionBy(*keys, "_bin").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("_before", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    full = full.withColumn("_d", F.col("_w") * F.coalesce(F.sum("_before").over(higher), F.lit(0)))
    return full.select(*keys, "_d")


def concordance(ranks: DataFrame, keys: Sequence[str], first: Column, second: Column, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """Per group: rows ``n``, ``pairs``, ``discordant`` pairs and ``tau``, (concordant - discordant) / pairs.

    A pair that ties in ``first`` or ``second`` is neither; it counts in ``pairs``. Rows
    with a null on either side take no part; a group with fewer than two rows has
    null ``tau``. ``first`` and ``second`` may be structs. Exact for groups of up to 4 * 10^9 rows.

    All rows are cut into slices along ``first`` and into bins along ``second``,
    of about ``rows_per_slice`` each. Pairs within a slice, and pairs of different slices within
    a bin, are counted by merging; all others by running sums over a table of
    slices by bins. A group in one slice needs only the first step.
    """
    keys = list(keys)
    points = ranks.select(*keys, first.alias("_x"), second.alias("_y")).where("_x is not null and _y is not null")
    points = cut(points.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w")))
    slices = max(1, -(-points.count() // rows_per_slice))

    def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
        ordered = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
        return cut(ordered.withColumn(name, F.monotonically_increasing_id()))

    # Ties of one side follow the other, so that no tie is an inversion.
    placed = numbered(points, [*keys, "_x", "_y"], "_px").withColumn("_slice", F.shiftright("_px", _ROW_BITS))
    placed = numbered(placed, [*keys, "_y", "_x"], "_py").withColumn("_bin", F.shiftright("_py", _ROW_BITS))
    schema = T.StructType([*[points.schema[k] for k in keys], T.StructField("_d", T.LongType())])

    def merged(df: DataFrame, part: str, order: Sequence[str]) -> DataFrame:
        rows = df.select(*keys, F.col(part).alias("_part"), *order, F.col("_py").alias("_rank"), "_w")
        rows = rows.repartition("_part").sortWithinPartitions("_part", *keys, *order)
        return rows.select(*keys, "_part", "_rank", "_w").mapInPandas(_counts(keys), schema)

    found = merged(placed, "_slice", ["_px"])
    if slices > 1:
        cells = cut(placed.groupBy(*keys, "_slice", "_bin").agg(F.sum("_w").alias("_w")))
        # At most one group for each limit between slices goes over it.
        wide = cells.groupBy(*keys).agg(F.min("_slice").alias("_a"), F.max("_slice").alias("_b")).where("_a < _b").drop("_a", "_b")

        def of(df: DataFrame) -> DataFrame:
            same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
            return df.alias("l").join(wide.alias("r"), same or F.lit(True), "left_semi")

        found = found.unionByName(merged(of(placed), "_bin", ["_slice", "_py"]))
        found = found.unionByName(_between(of(cells), keys))

    def measured(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(*keys, F.lit(name).alias("_name"), value.alias("_value"))

    parts = [measured(found, "discordant", F.col("_d")), measured(points, "n", F.col("_w")), measured(points, "both", _pairs("_w"))]
    for side in ("_x", "_y"):
        parts.append(measured(points.groupBy(*keys, side).agg(F.sum("_w").alias("_n")), side, _pairs("_n")))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    sums = {n: F.sum(F.when(F.col("_name") == n, F.col("_value")).otherwise(0)).alias(n) for n in ("n", "discordant", "_x", "_y", "both")}
    out = long.groupBy(*keys).agg(*sums.values()).withColumn("pairs", _pairs("n"))
    balance = F.col("pairs") - F.col("_x") - F.col("_y") + F.col("both") - 2 * F.col("discordant")
    return out.select(*keys, "n", "pairs", "discordant", F.when(F.col("pairs") > 0, balance / F.col("pairs")).alias("tau"))
