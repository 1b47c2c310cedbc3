"""Rolling statistics and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import roles_sql as Q
from faultline.operators import anomaly

SERIES = "pts AS (SELECT event_type AS metric_name, epoch_us(ts) AS us, event_id AS id, value FROM events)"
ROLL = Q.cte(SERIES, Q.rolling("pts", "metric_name"))
LOAD = """pts AS (SELECT l_suppkey, epoch_us(l_shipdate) AS us, l_orderkey * 10 + l_linenumber AS tie,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS id, l_extendedprice AS value FROM lineitem)"""


def series(t):
    return t.table("events").selectExpr("event_type as metric_name", "cast(ts as timestamp) as timestamp", "event_id as id", "value")


@query(
    "w1_w2_w3_w4_rolling_stats",
    ROLL
    + """ SELECT metric_name, id, n AS n_window, round(mean, 6) AS mean, round(sd, 6) AS stddev, mn AS minimum, mx AS maximum,
    round(z, 5) AS z_score, round(pct, 5) AS pct_change, round(pr::DOUBLE, 6) AS pct_rank FROM roll""",
)
def w1(t):
    s = anomaly.rolling_stats(series(t))
    return s.select(
        "metric_name",
        "id",
        "n_window",
        F.round("mean", 6).alias("mean"),
        F.round("stddev", 6).alias("stddev"),
        "minimum",
        "maximum",
        F.round("z_score", 5).alias("z_score"),
        F.round("pct_change", 5).alias("pct_change"),
        F.round("pct_rank", 6).alias("pct_rank"),
    )


@query(
    "w1_one_series",
    Q.cte("pts AS (SELECT 'all' AS metric_name, epoch_us(ts) AS us, event_id AS id, value FROM events)", Q.rolling("pts", "metric_name"))
    + " SELECT id, n AS n_window, round(mean, 6) AS mean, mn AS minimum, mx AS maximum, round(pr::DOUBLE, 6) AS pct_rank FROM roll",
)
def w1_hot(t):
    """All events as a single series: the case in which a plain window is one task."""
    s = anomaly.rolling_stats(series(t).withColumn("metric_name", F.lit("all")), slice_rows=1000)
    return s.select("id", "n_window", F.round("mean", 6).alias("mean"), "minimum", "maximum", F.round("pct_rank", 6).alias("pct_rank"))


@query(
    "w5_detect_anomalies",
    ROLL
    + """, sig AS (
      SELECT metric_name, id, 'z_score' AS signal_type, 2.5 AS threshold, z AS observed FROM roll WHERE n >= 4 AND abs(z) >= 2.5
      UNION ALL SELECT metric_name, id, 'percentage_change', 50.0, pct FROM roll WHERE n >= 4 AND abs(pct) >= 50
      UNION ALL SELECT metric_name, id, 'percentile', CASE WHEN pr <= 5 THEN 5.0 ELSE 95.0 END, pr FROM roll WHERE n >= 4 AND (pr <= 5 OR pr >= 95))
    SELECT metric_name, id, signal_type, threshold::DOUBLE AS threshold, round(observed::DOUBLE, 6) AS observed FROM sig""",
)
def w5(t):
    d = anomaly.detect_anomalies(series(t))
    return d.select("metric_name", "id", "signal_type", "threshold", "observed")


@query(
    "w6_latest_stats",
    ROLL
    + """, l AS (SELECT metric_name, count(*) - 1 AS prior_points, arg_max(roll, (us, id)) FILTER (WHERE n >= 4) AS r FROM roll GROUP BY 1)
    SELECT metric_name, prior_points, r.value AS latest_value, r.n AS n_window, round(r.mean, 6) AS mean, round(r.sd, 6) AS stddev,
      round(r.z, 5) AS z_score FROM l WHERE r IS NOT NULL""",
)
def w6(t):
    s = anomaly.latest_stats(series(t))
    return s.select(
        "metric_name",
        "prior_points",
        "latest_value",
        "n_window",
        F.round("mean", 6).alias("mean"),
        F.round("stddev", 6).alias("stddev"),
        F.round("z_score", 5).alias("z_score"),
    )


@query(
    "w5_supplier_price_anomalies",
    Q.cte(LOAD, Q.rolling("pts", "l_suppkey"))
    + f""" SELECT l_suppkey, count(*) AS points, count(*) FILTER (WHERE n >= 4 AND {Q.FIRED}) AS flagged,
    count(*) FILTER (WHERE n >= 4 AND abs(z) >= 2.5) AS by_z FROM roll GROUP BY 1""",
)
def w5_load(t):
    """A load-sized series set: price per supplier in ship order."""
    li = t.table("lineitem").selectExpr(
        "l_suppkey",
        "cast(l_shipdate as timestamp) as timestamp",
        "struct(l_orderkey, l_linenumber, l_extendedprice) as id",
        "l_extendedprice as value",
    )
    s = anomaly.rolling_stats(li, keys=["l_suppkey"])
    signals = F.size(anomaly._signals(anomaly.AnomalyThresholds(), "value")) > 0
    return s.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.col("evaluated") & signals).alias("flagged"),
        F.count_if(F.col("evaluated") & (F.abs("z_score") >= 2.5)).alias("by_z"),
    )
