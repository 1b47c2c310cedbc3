"""Rolling statistics and metric anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import AnomalyThresholds
from faultline.functions import scores as C
from faultline.functions.scores import pct_change, pct_rank, z_score
from faultline.operators.slices import SLICE_ROWS, equal_slices, running_total, time_slice, with_carry
from faultline.operators.timeline import PlacedEntries, SharedEntries
from faultline.session import cut


def rolling_stats(
    df: DataFrame,
    cfg: AnomalyThresholds = AnomalyThresholds(),
    keys: Sequence[str] = ("metric_name",),
    ts: str = "timestamp",
    tie: str = "id",
    value: str = "value",
    slice_us: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Statistics of the ``window_size`` points before each point of a series.

    A series of more than ``slice_rows`` points is cut into slices of about as
    many, each preloaded with the points before it, so neither a dominant series
    nor a dense hour ends in one task. ``slice_us`` gives slices of fixed time instead.
    """
    keys = list(keys)
    k = cfg.window_size
    if slice_us:
        rows, many = df.withColumn("_slice", time_slice(ts, slice_us)), True
    else:
        rows, many = equal_slices(df, keys, ts, slice_rows)
    if many:
        rows = with_carry(rows, keys, [ts, tie], [value], k, "_slice")
        part = Window.partitionBy(*keys, "_slice").orderBy(ts, tie)
    else:
        rows = rows.withColumn("_carried", F.lit(False))
        part = Window.partitionBy(*keys).orderBy(ts, tie)
    frame = part.rowsBetween(-k, -1)
    v = F.col(value)
    history = F.collect_list(v).over(frame)
    out = rows.withColumns(
        {
            "n_window": F.count(v).over(frame),
            "mean": F.avg(v).over(frame),
            "stddev": F.coalesce(F.stddev_samp(v).over(frame), F.lit(0.0)),
            "minimum": F.min(v).over(frame),
            "maximum": F.max(v).over(frame),
            "previous": F.lag(v, 1).over(part),
            "_history": history,
        }
    )
    out = out.filter(~F.col("_carried"))
    return out.withColumns(
        {
            "z_score": z_score(v, F.col("mean"), F.col("stddev"), cfg.min_stddev),
            "pct_change": pct_change(v, F.coalesce("previous", "mean")),
            "pct_rank": pct_rank(v, F.col("_history")),
            "evaluated": F.col("n_window") >= cfg.min_points - 1,
        }
    ).drop("_carried", "_slice", "_history")


def _signals(cfg: AnomalyThresholds, value: str):
    mean, sd = F.round("mean", 6), F.round("stddev", 6)
    null = F.lit(None).cast("double")
    z, pct, rank = F.col("z_score"), F.col("pct_change"), F.col("pct_rank")

    def signal(kind, threshold, observed, stddev, detail):
        return F.struct(
            F.lit(kind).alias("signal_type"),
            threshold.alias("threshold"),
            F.round(observed, 6).alias("observed"),
            mean.alias("baseline_mean"),
            stddev.alias("baseline_stddev"),
            mean.alias("moving_average"),
            F.lit(cfg.window_size).alias("window_size"),
            detail.alias("detail"),
        )

    low, high = cfg.percentile_low, cfg.percentile_high
    return F.array_compact(
        F.array(
            F.when(
                F.abs(z) >= cfg.z_score,
                signal(
                    "z_score",
                    F.lit(cfg.z_score),
                    z,
                    sd,
                    F.format_string(f"z-score %.2f exceeded threshold {cfg.z_score:.2f}", z),
                ),
            ),
            F.when(
                F.abs(pct) >= cfg.percentage_change,
                signal(
                    "percentage_change",
                    F.lit(cfg.percentage_change),
                    pct,
                    null,
                    F.format_string(f"percentage change %.2f%% exceeded threshold {cfg.percentage_change:.2f}%%", pct),
                ),
            ),
            F.when(
                (rank <= low) | (rank >= high),
                signal(
                    "percentile",
                    F.when(rank <= low, F.lit(low)).otherwise(F.lit(high)),
                    rank,
                    sd,
                    F.format_string(f"percentile rank %.2f outside [{low:.2f}, {high:.2f}]", rank),
                ),
            ),
        )
    )


def detect_anomalies(
    df: DataFrame, cfg: AnomalyThresholds = AnomalyThresholds(), keys: Sequence[str] = ("metric_name",), **kw
) -> DataFrame:
    """One row per anomaly signal of each evaluated point."""
    ts, tie, value = kw.get("ts", "timestamp"), kw.get("tie", "id"), kw.get("value", "value")
    stats = rolling_stats(df, cfg, keys, **kw).filter("evaluated")
    return stats.select(*keys, ts, tie, value, F.explode(_signals(cfg, value)).alias("_s")).select(
        *keys, ts, tie, value, "_s.*"
    )


def latest_stats(
    df: DataFrame, cfg: AnomalyThresholds = AnomalyThresholds(), keys: Sequence[str] = ("metric_name",), **kw
) -> DataFrame:
    """Statistics at the last evaluated point of each series."""
    ts, tie, value = kw.get("ts", "timestamp"), kw.get("tie", "id"), kw.get("value", "value")
    names = ("n_window", "mean", "stddev", "minimum", "maximum", "z_score", "pct_rank", "pct_change")
    body = F.struct(F.col(ts), F.col(tie), F.col(value).alias("latest_value"), *names)
    stats = rolling_stats(df, cfg, keys, **kw)
    last = stats.groupBy(*keys).agg(
        F.max_by(F.when(F.col("evaluated"), body), F.when(F.col("evaluated"), F.struct(ts, tie))).alias("_last"),
        (F.count(F.lit(1)) - 1).alias("prior_points"),
    )
    return last.filter(F.col("_last").isNotNull()).select(
        *keys, "prior_points", "_last.latest_value", *[f"_last.{n}" for n in names]
    )


def annotate_anomalies(
    entries: DataFrame,
    cfg: AnomalyThresholds = AnomalyThresholds(),
    extra_keys: Sequence[str] = (),
    slice_us: int | None = None,
) -> DataFrame:
    """Set ``anomaly`` on metric entries whose (series, time) was signalled.

    A series is an incident's metric name (title where there is none) plus
    ``extra_keys``. Every point of a signalled time stamp is flagged.
    """
    metric = F.col("category") == "metric"
    keys = ["incident_id", "_series", *extra_keys]
    points = entries.filter(metric).withColumn("_series", _series())
    times = _fired_times(points, cfg, keys, slice_us)
    marked = points.join(times, [*keys, "timestamp"], "left").withColumn(
        "anomaly", F.coalesce("_fired", F.lit(False))
    )
    rest = entries.filter(~metric).withColumn("anomaly", F.lit(False))
    return rest.unionByName(marked.drop("_series", "_fired"))


def _series() -> Column:
    return F.coalesce(F.when(F.col("metric_name") != "", F.col("metric_name")), F.col("title"))


def _fired_times(points: DataFrame, cfg: AnomalyThresholds, keys: Sequence[str], slice_us: int | None = None) -> DataFrame:
    """The times (keys, timestamp, _fired) of a series at which a point is signalled."""
    scored = points.filter(F.col("value").isNotNull()).select(*keys, "timestamp", "id", "value")
    stats = rolling_stats(scored, cfg, keys, slice_us=slice_us)
    fired = F.col("evaluated") & (F.size(_signals(cfg, "value")) > 0)
    return stats.groupBy(*keys, "timestamp").agg(F.bool_or(fired).alias("_fired")).filter("_fired")


@dataclass(frozen=True)
class SharedFlags:
    """Anomaly flags of shared entries.

    ``entries`` carry ``anomaly`` as the whole series of their scope gives it. The first
    ``window_size`` points of an incident's own series have a shorter history: ``changes``
    (incident_id, scope, _series, timestamp, anomaly) are the times where its flag differs.
    """

    entries: SharedEntries
    changes: DataFrame

    def each(self, placed: PlacedEntries, rows: DataFrame, wanted: Column, parts: DataFrame | None = None) -> DataFrame:
        """Those ``rows`` of ``placed`` that are ``wanted``, for each incident and with its own ``anomaly``, with the columns of ``parts``.

        ``parts`` are spans or pieces of them. Only metrics up to an incident's last change are held against ``changes``.
        """
        parts = placed.spans if parts is None else parts
        metric = F.col("category") == "metric"
        last = self.changes.groupBy("incident_id", "scope").agg(F.max("timestamp").alias("timestamp"))
        at = placed.places(last.select("scope", "timestamp", F.lit(2).alias("_side")))
        heads = cut(last.join(at, ["scope", "timestamp"]).select("incident_id", F.col("_place").alias("_head")))
        known = parts.join(heads, "incident_id", "left")
        tails = known.withColumn("_from", F.greatest("_from", "_head")).drop("_head")
        begun = known.filter("_head is not null").withColumn("_upto", F.least("_upto", "_head")).drop("_head")
        keyed = self.changes.select("incident_id", F.col("_series").alias("_s"), F.col("timestamp").alias("_t"), F.col("anomaly").alias("_change"))
        early = placed.pairs(rows.filter(metric).withColumn("_s", _series()), begun).withColumn("_t", F.col("timestamp"))
        early = early.join(keyed, ["incident_id", "_s", "_t"], "left").withColumn("anomaly", F.coalesce("_change", "anomaly"))
        out = placed.pairs(rows.filter(wanted & metric), tails).unionByName(early.drop("_s", "_t", "_change").filter(wanted))
        return out.unionByName(placed.pairs(rows.filter(wanted & ~metric), parts))

    def flagged(self) -> DataFrame:
        """The metric entries of every incident with its ``anomaly``."""
        placed, columns = self.entries.placed(), self.entries.events.columns
        metric = F.col("category") == "metric"
        rows = placed.events.filter(metric)
        return self.each(placed, rows, metric).select(*columns).unionByName(placed.groups.filter(metric).select(*columns))


def annotate_shared(entries: SharedEntries, cfg: AnomalyThresholds = AnomalyThresholds()) -> SharedFlags:
    """What ``annotate_anomalies`` gives for the entries of each incident; ids of incidents in ``spans`` must be unique.

    A point's statistics depend on where its incident's series begins only if it
    begins less than ``window_size`` points before. So a series is judged once as
    a whole, and its first points once for each point where some window begins.
    """
    keys = ["scope", "_series"]
    events = cut(entries.events)
    scored = events.filter((F.col("category") == "metric") & F.col("value").isNotNull()).withColumnRenamed("incident_id", "scope")
    points = cut(scored.select("scope", _series().alias("_series"), "timestamp", "id", "value").filter("_series is not null"))
    times = points.groupBy(*keys, "timestamp").agg(F.count(F.lit(1)).alias("_n")).withColumn("_side", F.lit(1))
    begins = entries.spans.select("scope", F.col("window_start").alias("timestamp")).distinct().join(points.select(*keys).distinct(), "scope")
    line = cut(times.unionByName(begins.select(*keys, "timestamp", F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_side"))))
    sliced, _ = equal_slices(line, keys, "timestamp")
    placed = cut(running_total(sliced, keys, ["_slice"], ["timestamp", "_side"], F.col("_n"), "_at").drop("_slice"))
    k = cfg.window_size
    starts = placed.filter("_side = 0").select(*keys, F.col("timestamp").alias("window_start"), F.col("_at").alias("_start"))
    near = F.explode(F.array(F.floor(F.col("_start") / k), F.floor(F.col("_start") / k) + 1)).alias("_b")
    at = placed.filter("_side = 1").select(*keys, "timestamp", "_at", F.floor(F.col("_at") / k).alias("_b"))
    heads = starts.select(*keys, "_start").distinct().select(*keys, "_start", near).join(at, [*keys, "_b"])
    heads = cut(heads.filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + k)).select(*keys, "_start", "timestamp"))
    whole = cut(_fired_times(points, cfg, keys))
    own = _fired_times(cut(heads.join(points, [*keys, "timestamp"])), cfg, [*keys, "_start"])
    both = heads.join(own, [*keys, "_start", "timestamp"], "left").join(whole.withColumnRenamed("_fired", "_whole"), [*keys, "timestamp"], "left")
    differ = both.filter(F.col("_fired").isNull() != F.col("_whole").isNull())
    differ = differ.select(*keys, "_start", "timestamp", F.col("_fired").isNotNull().alias("anomaly"))
    seen = entries.spans.join(starts, ["scope", "window_start"]).join(differ, [*keys, "_start"])
    changes = cut(seen.filter(F.col("timestamp") <= F.col("window_end")).select("incident_id", *keys, "timestamp", "anomaly"))
    listed = events.filter("category is not null").withColumn("_series", F.when(F.col("category") == "metric", _series()))
    marked = listed.join(whole.withColumnRenamed("scope", "incident_id"), ["incident_id", "_series", "timestamp"], "left")
    flagged = marked.withColumn("anomaly", F.coalesce("_fired", F.lit(False))).drop("_series", "_fired")
    return SharedFlags(replace(entries, events=flagged, groups=annotate_anomalies(entries.groups, cfg)), changes)


def predicate_counts(entries: DataFrame | SharedFlags) -> DataFrame:
    """Entries of all incidents by category: how many are anomalies, errors, flagged metrics, resolved alerts."""
    category, severity = F.col("category"), F.col("severity")
    if isinstance(entries, SharedFlags):
        shared = entries.entries
        series = _series().alias("_series")
        flagged = (category == "metric") & F.col("anomaly")
        own = shared.groups.select("category", "severity", "status", F.lit(1).cast("bigint").alias("_n"), flagged.cast("bigint").alias("_f"))
        seen = shared.seen()
        common = seen.select("category", "severity", "status", F.col("seen").alias("_n"), F.when(flagged, F.col("seen")).otherwise(0).alias("_f"))
        sign = F.when(F.col("anomaly"), 1).otherwise(-1)
        moved = entries.changes.groupBy("scope", "_series", "timestamp").agg(F.sum(sign).alias("_f"))
        metrics = shared.events.filter(category == "metric").select(F.col("incident_id").alias("scope"), series, "timestamp", "category")
        apart = metrics.join(moved, ["scope", "_series", "timestamp"]).select("category", F.lit(0).cast("bigint").alias("_n"), "_f")
        rows = own.unionByName(common).unionByName(apart, allowMissingColumns=True)
    else:
        flagged = (category == "metric") & F.col("anomaly")
        rows = entries.withColumns({"_n": F.lit(1).cast("bigint"), "_f": F.coalesce(flagged, F.lit(False)).cast("bigint")})

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))

    return rows.groupBy("category").agg(
        total(C.is_anomaly(category, severity)).alias("n_anomaly"),
        total(C.is_error(category, severity)).alias("n_error"),
        F.sum("_f").alias("n_flagged"),
        total(C.is_resolved(category, F.col("status"))).alias("n_resolved"),
    )
