"""Windows over groups that may hold a large share of all rows.

A plain window sends a whole group to one task. Here a group is cut into
slices along its sort order; each slice is a window partition of its own and
gets the few rows, or the one offset, that it needs from the slices before it.
Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut


def time_slice(ts: str | Column, width_us: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / width_us).cast("bigint")


SLICE_ROWS = 250_000
BROADCAST_BOUNDS = 1_000_000  # limits of slices, 8 bytes each
BROADCAST_KEYS = 20_000  # keys of a grid with their number of cells


def equal_slices(
    df: DataFrame, keys: Sequence[str], ts: str, rows_per_slice: int = SLICE_ROWS, name: str = "_slice"
) -> tuple[DataFrame, bool]:
    """Number slices of about ``rows_per_slice`` rows along time, and say whether any series has more than one.

    Limits are quantiles of a sketch of each longer series, so an hour with most of
    the rows gets most of the slices. Rows of one time stamp stay together; null
    times are in the first slice. Limits of a series are off by a hundredth of a
    slice at most.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= rows_per_slice:
        return df.withColumn(name, F.lit(0)), False
    depth = -(-most // rows_per_slice)
    us = F.unix_micros(ts)
    sketch = F.percentile_approx(us, [k / depth for k in range(1, depth)], max(10_000, 100 * depth))
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch.alias("_b")).where(F.col("_n") > rows_per_slice)
    step = F.greatest(F.floor(F.lit(depth * rows_per_slice) / F.col("_n")), F.lit(1))
    some = F.array_distinct(F.transform(F.sequence(step, F.lit(depth - 1).cast("long"), step), lambda k: F.element_at("_b", k.cast("int"))))
    limits = cut(long.where(step < depth).select(*[F.col(k).alias(f"_b_{k}") for k in keys], some.alias("_b")))
    held = limits.agg(F.sum(F.size("_b"))).first()[0] or 0
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    joined = df.withColumn("_us", us).join(F.broadcast(limits) if held <= BROADCAST_BOUNDS else limits, on, "left")
    width = int(depth**0.5) + 1  # limits are found by every ``width``th first

    def below(limits: Column) -> Column:
        return F.size(F.filter(limits, lambda b: b < F.col("_us")))

    coarse = F.expr(f"transform(sequence({width}, greatest(size(_b), {width}), {width}), k -> get(_b, k - 1))")
    joined = joined.withColumn("_c", F.coalesce(below(coarse), F.lit(0)) * width)
    fine = F.coalesce(below(F.slice("_b", F.col("_c") + 1, width)), F.lit(0))
    number = F.when(F.col("_b").isNull() | F.col("_us").isNull(), 0).otherwise(F.col("_c") + fine)
    return joined.withColumn(name, number).select(*df.columns, name), True


def positions(
    df: DataFrame, keys: Sequence[str], slices: Sequence[str], order: Sequence[str | Column], name: str
) -> DataFrame:
    """1-based rank within ``keys`` by (slices, order).

    ``slices`` must be a prefix of the wanted order. Only slice counts are
    ranked across a whole group; rows are ranked within their slice.
    """
    keys, slices = list(keys), list(slices)
    counts = df.groupBy(*keys, *slices).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, *slices, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, *slices).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inside))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, *slices]]
    joined = ranked.alias("r").join(offsets.alias("o"), same, "inner")
    return joined.select("r.*", (F.col("o._offset") + F.col("r._rank")).cast("bigint").alias(name)).drop("_rank")


def with_carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], k: int, slice_col: str
) -> DataFrame:
    """Rows plus, for each slice, copies of the ``k`` rows before it.

    Copies have ``_carried`` true and hold keys, order and values only. A
    slice passes on at most ``k`` rows, so what is gathered per group is
    bounded by ``k`` times its number of slices, in arrays of at most k*k.
    """
    keys, order, values = list(keys), list(order), list(values)
    last = Window.partitionBy(*keys, slice_col).orderBy(*[F.desc(c) for c in order])
    tails = (
        df.select(*keys, slice_col, *order, *values)
        .withColumn("_rn", F.row_number().over(last))
        .filter(F.col("_rn") <= k)
        .groupBy(*keys, slice_col)
        .agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(-k, -1)
    found = F.flatten(F.collect_list("_tail").over(earlier))
    carried = (
        tails.withColumn("_found", found)
        .filter(F.size("_found") > 0)
        .select(*keys, slice_col, F.explode(F.slice("_found", F.greatest(F.lit(1), F.size("_found") - k + 1), k)).alias("_r"))
        .select(*keys, slice_col, "_r.*", F.lit(True).alias("_carried"))
    )
    return df.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[str],
    order: Sequence[str | Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Sum of ``value`` over the rows before each row within ``keys``."""
    keys, slices = list(keys), list(slices)
    sums = df.groupBy(*keys, *slices).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *slices, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, *slices).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, *slices]]
    joined = local.alias("r").join(offsets.alias("o"), same, "inner")
    return joined.select("r.*", (F.col("o._offset") + F.col("r._local")).alias(name)).drop("_local")


def counts_within(
    rows: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    id_col: str = "incident_id",
    ts: str = "timestamp",
    start: str = "window_start",
    end: str = "window_end",
) -> DataFrame:
    """(id, keys, n): how many rows of its keys a span holds from ``start`` to ``end``, where any.

    A count is the difference of the running totals at both ends, so the work
    follows rows plus spans, not their pairs. Spans of one id are summed.
    """
    keys = list(keys)
    us = F.unix_micros(ts)
    none = F.lit(None).cast(spans.schema[id_col].dataType)
    points = rows.groupBy(*keys, us.alias("_us")).agg(F.count(F.lit(1)).alias("_n"))
    points = points.select(*keys, "_us", F.lit(1).alias("_side"), "_n", none.alias(id_col))
    ordered = spans.filter(F.col(start) <= F.col(end))
    ends = [
        ordered.select(*keys, F.unix_micros(c).alias("_us"), F.lit(side).alias("_side"), F.lit(0).cast("bigint").alias("_n"), id_col)
        for c, side in ((start, 0), (end, 2))
    ]
    line = cut(points.unionByName(ends[0]).unionByName(ends[1]).withColumn("_at", F.timestamp_micros("_us")))
    sliced, _ = equal_slices(line, keys, "_at")
    at = running_total(sliced, keys, ["_slice"], ["_us", "_side"], F.col("_n"), "_before").filter(F.col("_side") != 1)
    signed = F.when(F.col("_side") == 2, F.col("_before")).otherwise(-F.col("_before"))
    return at.groupBy(id_col, *keys).agg(F.sum(signed).alias("n")).filter(F.col("n") > 0)


def grid_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: str,
    right_id: str,
    residual: Column,
    pairs_per_task: int = 5_000_000,
) -> DataFrame:
    """Rows of both sides that share ``keys`` and satisfy ``residual``.

    A block of n x m comparisons is cut into a square grid of cells, so one
    large block becomes many equal join keys. Column names of the two sides
    must differ except for ``keys``; only pairs that pass are emitted. Neither
    side is ever broadcast: rows may be exploded or packed tightly in files, so
    the sizes that Spark assumes for them say little of what a driver would hold.
    """
    keys = list(keys)
    nl = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    nr = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    cells = F.ceil(F.sqrt(F.col("_nl").cast("double") * F.col("_nr") / pairs_per_task)).cast("int")
    sides = cut(nl.join(nr.hint("merge"), keys).select(*keys, F.greatest(F.lit(1), cells).alias("_cells")))
    sides = F.broadcast(sides) if sides.count() <= BROADCAST_KEYS else sides.hint("shuffle_hash")
    every = F.sequence(F.lit(0), F.col("_cells") - 1)

    def own(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.col("_cells").cast("bigint")).cast("int")

    a = left.join(sides, keys).withColumn("_row", own(left_id)).withColumn("_col", F.explode(every)).drop("_cells")
    b = right.join(sides, keys).withColumn("_col", own(right_id)).withColumn("_row", F.explode(every)).drop("_cells")
    return a.join(b.hint("merge"), [*keys, "_row", "_col"]).filter(residual).drop("_row", "_col")
