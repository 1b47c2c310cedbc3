"""As-of joins as running minima over slices of equal depth: linear work, no copies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scores import lag_score
from faultline.operators.slices import SLICE_ROWS, equal_slices


@dataclass(frozen=True)
class Target:
    """Which rows are targets, how far ahead, and whether the lag must be above 0."""

    is_target: Column
    max_lag_us: int
    strict: bool = True


def next_targets(
    df: DataFrame,
    keys: Sequence[str],
    targets: dict[str, Target],
    payload: Sequence[str] = (),
    ts: str = "timestamp",
    tie: str = "id",
    slice_rows: int = SLICE_ROWS,
    ahead: bool = True,
) -> DataFrame:
    """Add to each row, per name, the earliest later target within its lag.

    The added column is a struct (us, <tie>, payload...) or null; ties go to
    the lowest ``tie``. A row never matches itself. Without ``ahead`` it is the
    latest earlier target, and ties go to the highest ``tie``. A key of more than
    ``slice_rows`` rows is cut into slices of about as many; what lies ahead of a
    slice is known from the first target of each slice, so no row is copied.
    """
    keys = list(keys)
    flags = {name: F.coalesce(t.is_target, F.lit(False)) for name, t in targets.items()}
    rows, many = equal_slices(df, keys, ts, slice_rows)
    rows = rows.withColumn("_us", F.unix_micros(ts))
    body = F.struct(F.col("_us").alias("us"), F.col(tie), *[F.col(c) for c in payload])
    part = Window.partitionBy(*keys, "_slice") if many else Window.partitionBy(*keys)
    pick, along = (F.min, F.desc) if ahead else (F.max, F.asc)
    by_time = part.orderBy(along("_us"))
    by_row = part.orderBy(along("_us"), along(tie))
    added = {}
    for name, t in targets.items():
        candidate = F.when(flags[name], body)
        if t.strict:
            best = pick(candidate).over(by_time.rangeBetween(Window.unboundedPreceding, -1))
        else:
            near = pick(candidate).over(by_time.rangeBetween(Window.unboundedPreceding, 0))
            after = pick(candidate).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
            best = F.when(near[tie] == F.col(tie), after).otherwise(near)
        added[name] = best
    out = rows.withColumns(added)
    if many:
        firsts = rows.groupBy(*keys, "_slice").agg(*[pick(F.when(flags[n], body)).alias(f"_f_{n}") for n in targets])
        beyond = Window.partitionBy(*keys).orderBy(F.asc("_slice") if ahead else F.desc("_slice")).rowsBetween(1, Window.unboundedFollowing)
        names = [*keys, "_slice"]
        later = firsts.select(*[F.col(c).alias(f"_k_{c}") for c in names], *[pick(f"_f_{n}").over(beyond).alias(f"_f_{n}") for n in targets])
        out = out.join(later, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names], "left")
        out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_f_{n}")) for n in targets})
        out = out.drop(*[f"_k_{c}" for c in names], *[f"_f_{n}" for n in targets])
    kept = {n: F.when(F.abs(F.col(n)["us"] - F.col("_us")) <= t.max_lag_us, F.col(n)) for n, t in targets.items()}
    return out.withColumns(kept).drop("_us", "_slice")


def asof_forward(
    src: DataFrame,
    tgt: DataFrame,
    keys: Sequence[str],
    max_lag_us: int,
    strict: bool = True,
    min_score: float = 0.1,
    ts: str = "timestamp",
    tie: str = "id",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each source with its earliest target ahead: keys, ids, times, lag, score."""
    keys = list(keys)
    both = (
        src.select(*keys, tie, ts, F.lit(True).alias("_src"), F.lit(False).alias("_tgt"))
        .unionByName(tgt.select(*keys, tie, ts, F.lit(False).alias("_src"), F.lit(True).alias("_tgt")))
        .groupBy(*keys, tie, ts)
        .agg(F.bool_or("_src").alias("_src"), F.bool_or("_tgt").alias("_tgt"))
    )
    found = next_targets(both, keys, {"hit": Target(F.col("_tgt"), max_lag_us, strict)}, ts=ts, tie=tie, slice_rows=slice_rows)
    lag = F.col("hit.us") - F.unix_micros(ts)
    score = lag_score(lag, max_lag_us)
    return (
        found.filter(F.col("_src") & F.col("hit").isNotNull())
        .filter(score >= min_score)
        .select(
            *keys,
            F.col(tie).alias("source_id"),
            F.col(f"hit.{tie}").alias("target_id"),
            F.col(ts).alias("source_ts"),
            F.timestamp_micros("hit.us").alias("target_ts"),
            lag.alias("lag_us"),
            F.round(score, 6).alias("score"),
        )
    )
