"""The driver's tables in the roles of the data model.

Each role is a projection or aggregation of a whole table, so it grows with
its table. ``roles_sql`` states the same roles in SQL.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import spread

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """The table over all cores, for queries with much work per row."""
        return spread(self.table(name))

    @cached_property
    def services(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "cast(n_nationkey as bigint) as id", "cast(n_regionkey + 1 as bigint) as project_id", "lower(n_name) as name"
        )

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("region").selectExpr("cast(r_regionkey + 1 as bigint) as id", "r_name as name")

    @cached_property
    def events(self) -> DataFrame:
        kind = (
            "case event_type when 'error' then 'LOG' when 'click' then 'METRIC' when 'purchase' then 'ALERT' "
            "when 'signup' then 'DEPLOYMENT' else 'TRACE' end"
        )
        base = self.wide("events").selectExpr(
            "event_id",
            "user_id",
            "value as v",
            "cast(ts as timestamp) as timestamp",
            f"{kind} as event_type",
            "cast(get_json_object(props, '$.k') as bigint) as k",
        )
        log, metric, alert = "event_type = 'LOG'", "event_type = 'METRIC'", "event_type = 'ALERT'"
        deployment, trace = "event_type = 'DEPLOYMENT'", "event_type = 'TRACE'"
        return base.selectExpr(
            "event_id as id",
            "1 + (event_id div 50) % 5 as project_id",
            "case when event_id % 3 = 0 then null else user_id % 25 end as service_id",
            "event_type",
            "timestamp",
            "case event_id % 4 when 0 then null when 1 then 'staging' else 'production' end as environment",
            "'stream' as source",
            f"case when {log} then if(v >= 20, 'HIGH', 'LOW') when {alert} then if(v > 100, 'CRITICAL', 'HIGH') end as severity",
            f"""case when {log} then concat('request ', k, ' failed for user ', user_id, ' in module ', chr(97 + k % 7))
                when {alert} then concat('latency alert on route ', k % 5)
                when {metric} then concat('latency_', user_id % 4)
                when {deployment} then concat('release ', k) else concat('span ', k) end as message""",
            f"case when {metric} then concat('latency_', user_id % 4) end as metric_name",
            f"case when {metric} then v end as value",
            f"case when {alert} then if(event_id % 4 = 0, 'RESOLVED', 'FIRING') end as status",
            f"case when {log} or {trace} then concat('t', event_id div 8) end as trace_id",
            f"case when {trace} then concat('s', event_id) end as span_id",
            f"case when {trace} then concat('s', event_id - 1) end as parent_span_id",
            f"case when {deployment} then concat('org/nation_', user_id % 25) end as repository",
            f"case when {deployment} then concat('v', k) end as version",
            f"case when {deployment} then array(concat('src/module ', chr(97 + k % 7)), 'docs/readme.md') end as changed_files",
            f"case when {log} and event_id % 2 = 0 then (1 + (event_id div 50) % 5) * 100 + k % 7 end as error_group_id",
            "user_id",
            "k",
            "v",
        )

    @cached_property
    def groups(self) -> DataFrame:
        logs = self.events.filter("event_type = 'LOG'").withColumn("m", F.expr("k % 7"))
        return (
            logs.groupBy("project_id", "m")
            .agg(
                F.count(F.lit(1)).alias("occurrence_count"),
                F.min("timestamp").alias("first_seen"),
                F.max("timestamp").alias("last_seen"),
                F.max("service_id").alias("s"),
            )
            .selectExpr(
                "project_id * 100 + m as id",
                "project_id",
                "if(m % 2 = 0, null, s) as service_id",
                "concat('request {id} failed for user {id} in module ', chr(97 + m)) as normalized_message",
                "'HIGH' as severity",
                "occurrence_count",
                "first_seen",
                "last_seen",
            )
        )

    @cached_property
    def incidents(self) -> DataFrame:
        orders = self.table("orders").groupBy("o_custkey").agg(
            F.min("o_orderpriority").alias("p"),
            F.min_by("o_orderstatus", "o_orderkey").alias("s"),
            F.count(F.lit(1)).alias("occurrence_count"),
        )
        started = "timestamp_micros(1704067200000000 + (o_custkey * 37 % 41760) * 60000000)"
        from faultline.functions.fingerprints import incident_fingerprint

        rows = orders.selectExpr(
            "o_custkey as id",
            "1 + o_custkey % 5 as project_id",
            "case when o_custkey % 7 = 0 then null else o_custkey % 25 end as service_id",
            "if(o_custkey % 3 = 0, 'staging', 'production') as environment",
            """case substring(p, 1, 1) when '1' then 'CRITICAL' when '2' then 'HIGH' when '3' then 'MEDIUM'
               when '4' then 'INFO' else 'LOW' end as severity""",
            "case s when 'F' then 'RESOLVED' when 'P' then 'IDENTIFIED' else 'OPEN' end as status",
            "concat(lower(substring(p, 3)), ' order backlog for customer ', o_custkey) as title",
            f"{started} as started_at",
            f"case when s <> 'O' or o_custkey % 5 > 0 then {started} + interval 3 hours end as ended_at",
            "occurrence_count",
        )
        print_of = incident_fingerprint(F.col("service_id"), F.col("environment"), F.col("title"))
        return rows.withColumn("fingerprint", print_of)

    @cached_property
    def lines(self) -> DataFrame:
        docs = self.wide("documents").selectExpr("doc_id", "lang", "source", "posexplode(split(text, '\\n')) as (n, line)")
        return docs.filter("trim(line) <> ''").selectExpr(
            "concat('doc-', doc_id) as file",
            "doc_id",
            "cast(n + 1 as bigint) as line_number",
            "line",
            "source",
            "lang",
            "timestamp_micros(1704067200000000 + doc_id * 60000000 + n * 1000000) as at",
            "case doc_id % 4 when 0 then 'ERROR' when 1 then 'WARN' when 2 then 'info' else 'fatal' end as level",
        )

    @cached_property
    def records(self) -> DataFrame:
        """Log lines as normalized records with project, environment and service."""
        from faultline.functions.fields import parse_severity
        from faultline.functions.text import message_pattern, norm_name, norm_ws

        return self.lines.select(
            F.expr("1 + doc_id % 5").alias("project_id"),
            "file",
            "doc_id",
            "line_number",
            F.col("at").alias("timestamp"),
            parse_severity(F.col("level")).alias("severity"),
            norm_name(F.col("source")).alias("service"),
            norm_name(F.col("lang")).alias("environment"),
            norm_ws(F.col("line")).alias("message"),
            message_pattern(F.col("line")).alias("normalized_message"),
        )
