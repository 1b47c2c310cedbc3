"""Canonical mixed events: validation, ingestion, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import EVENT_TYPES, SEVERITIES
from faultline.functions.fields import ISO_TEXT, parse_epoch
from faultline.operators.normalize import KIND_FIELDS, event_message, event_payload
from faultline.sources.manifest import Table

ENVELOPE = ("timestamp", "source", "source_type", "source_id", "service", "environment", "raw_data", "normalized_data")

EVENT_SCHEMA = """
event_type string, timestamp string, source string, source_type string, source_id string, service string,
environment string, raw_data map<string,string>, normalized_data map<string,string>, message string, severity string,
host string, request_id string, trace_id string, metric_name string, value double, unit string,
labels map<string,string>, name string, status string, annotations map<string,string>, version string,
commit_sha string, author string, repository string, changed_files array<string>, span_id string,
parent_span_id string, operation_name string, duration_ms double
"""


def _blank(name: str) -> Column:
    return F.coalesce(F.col(f"e.{name}") == "", F.lit(True))


def parse_events(df: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """JSON events to (accepted wide events, rejects with their error list).

    Both come from one expression, so they split the input exactly. Times
    without a zone are UTC.
    """
    rows = checked_events(df, column)
    ok = F.size("errors") == 0
    return rows.filter(ok).drop("errors", column), rows.filter(~ok).select(
        *[c for c in df.columns if c != column], column, "errors"
    )


def checked_events(df: DataFrame, column: str = "payload") -> DataFrame:
    # What is read from the text comes out of a generator, through which no filter is
    # pushed: else each of the checks below would parse the text again.
    read = F.struct(
        F.from_json(column, EVENT_SCHEMA).alias("e"),
        F.json_object_keys(column).alias("keys"),
        F.get_json_object(column, "$.raw_data").alias("raw"),
    )
    e = df.withColumn("_read", F.explode(F.array(read))).withColumn("e", F.col("_read.e"))
    keys, raw = F.col("_read.keys"), F.col("_read.raw")
    kind = F.col("e.event_type")
    text = F.trim("e.timestamp")
    parsed = F.when(text.rlike(ISO_TEXT), F.try_to_timestamp(text)).when(
        text.rlike(r"^-?\d+(\.\d+)?$"), parse_epoch(text.try_cast("double"))
    )
    allowed = F.lit(None).cast("array<string>")
    for event_type, names in KIND_FIELDS.items():
        every = F.array(*[F.lit(n) for n in ("event_type", *ENVELOPE, *names)])
        allowed = F.when(kind == event_type, every).otherwise(allowed)
    unknown = F.array_except(keys, allowed)
    is_kind = {k: kind == k for k in EVENT_TYPES}
    duration = F.col("e.duration_ms")
    wrong_severity = F.col("e.severity").isNotNull() & ~F.col("e.severity").isin(*SEVERITIES)
    checks = {
        "not a JSON object": kind.isNull() & keys.isNull(),
        "unknown event_type": ~F.coalesce(kind.isin(*EVENT_TYPES), F.lit(False)),
        "bad timestamp": parsed.isNull(),
        "empty source": _blank("source"),
        "empty source_type": _blank("source_type"),
        "missing raw_data": ~F.coalesce(F.startswith(F.ltrim(raw), F.lit("{")), F.lit(False)),
        "unknown field": F.size(unknown) > 0,
        "missing message": is_kind["LOG"] & F.col("e.message").isNull(),
        "bad severity": (is_kind["LOG"] | is_kind["ALERT"]) & wrong_severity,
        "missing metric_name": is_kind["METRIC"] & _blank("metric_name"),
        "missing value": is_kind["METRIC"] & F.col("e.value").isNull(),
        "missing name": is_kind["ALERT"] & _blank("name"),
        "bad status": is_kind["ALERT"] & ~F.coalesce(F.col("e.status"), F.lit("FIRING")).isin("FIRING", "RESOLVED"),
        "missing trace_id": is_kind["TRACE"] & _blank("trace_id"),
        "missing span_id": is_kind["TRACE"] & _blank("span_id"),
        "negative duration": is_kind["TRACE"] & (duration < 0),
    }
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    status = F.when(is_kind["ALERT"], F.coalesce("e.status", F.lit("FIRING"))).otherwise(F.col("e.status"))
    out = e.withColumns({"errors": errors, "_ts": parsed, "_status": status})
    names = [f.name for f in out.schema["e"].dataType.fields if f.name not in ("timestamp", "status")]
    return out.select(
        *df.columns,
        "errors",
        F.col("_ts").alias("timestamp"),
        F.col("_status").alias("status"),
        *[F.col(f"e.{n}").alias(n) for n in names],
    )


def require_project(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Add ``project_known``; ``projects`` has id."""
    known = projects.select(F.col("id").alias("project_id"), F.lit(True).alias("_k")).distinct()
    return events.join(known, "project_id", "left").withColumn("project_known", F.coalesce("_k", F.lit(False))).drop("_k")


def resolve_service(events: DataFrame, services: DataFrame) -> DataFrame:
    """Add ``service_id`` by (project_id, exact name) and ``service_known``.

    A named but unknown service is not known; an unnamed one is fine.
    """
    names = services.select("project_id", F.col("name").alias("service"), F.col("id").alias("service_id"))
    joined = events.drop("service_id").join(names, ["project_id", "service"], "left")
    unnamed = F.coalesce(F.col("service") == "", F.lit(True))
    return joined.withColumn("service_known", unnamed | F.col("service_id").isNotNull())


def ingest(events: DataFrame, projects: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted event rows, one outcome per input row).

    ``events`` are ``checked_events`` with project_id, batch and index. The
    row id is 128 bits of a hash of (batch, index), so a retry writes the same ids.
    """
    rows = resolve_service(require_project(events, projects), services)
    status = (
        F.when(F.size("errors") > 0, "VALIDATION_ERROR")
        .when(~F.col("project_known"), "PROJECT_NOT_FOUND")
        .when(~F.col("service_known"), "SERVICE_NOT_FOUND")
        .otherwise("ACCEPTED")
    )
    rows = rows.withColumns({"ingest_status": status, "id": F.md5(F.concat_ws(":", "batch", "index"))})
    ok = F.col("ingest_status") == "ACCEPTED"
    outcomes = rows.select(
        "project_id",
        "batch",
        "index",
        F.col("ingest_status").alias("status"),
        F.when(ok, F.col("id")).alias("event_id"),
        "event_type",
        F.when(ok, F.col("service_id")).alias("service_id"),
        "errors",
    )
    accepted = event_payload(event_message(rows.filter(ok))).withColumn("event_date", F.to_date("timestamp"))
    return accepted.drop("errors", "ingest_status", "project_known", "service_known"), outcomes


def batch_totals(outcomes: DataFrame) -> DataFrame:
    ok = F.col("status") == "ACCEPTED"
    return outcomes.groupBy("project_id", "batch").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected")
    )


def write_events(accepted: DataFrame, path: str, write_id: str) -> bool:
    """Commit events to a table by project and day, the columns queries prune on; False for a retry."""
    return Table(accepted.sparkSession, path).write({"events": accepted}, write_id, ("project_id", "event_date"))


def read_events(spark: SparkSession, path: str) -> DataFrame | None:
    return Table(spark, path).read("events")


def write_evidence(items: DataFrame, relations: DataFrame, groups: DataFrame, path: str, built_at, write_id: str) -> bool:
    """Commit groups, items and relations together, each stamped with ``built_at``; False for a retry."""
    tables = {"groups": groups, "items": items, "relations": relations}
    stamped = {name: df.withColumn("built_at", F.lit(built_at)) for name, df in tables.items()}
    return Table(items.sparkSession, path).write(stamped, write_id)


def latest_evidence(spark: SparkSession, path: str, incident_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Groups, items and relations of each incident's latest build; pick incidents by a semi join."""
    table = Table(spark, path)
    groups = table.read("groups")
    if groups is None:
        raise ValueError(f"nothing has been written to {path}")
    if incident_ids is not None:
        groups = groups.join(incident_ids.select("incident_id"), "incident_id", "left_semi")
    newest = groups.groupBy("incident_id").agg(F.max("built_at").alias("built_at"))
    return {name: table.read(name).join(newest, ["incident_id", "built_at"], "left_semi") for name in ("groups", "items", "relations")}


def to_canonical_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One ``json`` text per row: fields in sorted order on every level, nulls kept."""
    from pyspark.sql import types as T

    def ordered(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = sorted(t.fields, key=lambda f: f.name)
            return F.when(c.isNotNull(), F.struct(*[ordered(c[f.name], f.dataType).alias(f.name) for f in fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: ordered(x, t.elementType))
        if isinstance(t, T.TimestampType):
            from faultline.operators.timeline import iso_text

            return F.regexp_replace(iso_text(c), r"\+00:00$", "Z")
        return c

    names = sorted(columns or df.columns)
    body = F.struct(*[ordered(F.col(n), df.schema[n].dataType).alias(n) for n in names])
    return df.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
