"""Record and event normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import fields as X
from faultline.functions import text as S


def _without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def normalize_records(df: DataFrame) -> DataFrame:
    """Clean the common fields of parsed records; ``raw_data`` stays as it is."""
    message = S.norm_ws(F.col("message"))
    env = S.norm_name(F.try_element_at("raw_data", F.lit("environment")))
    out = df.withColumns(
        {
            "message": message,
            "normalized_message": S.message_pattern(F.col("message")),
            "service": S.norm_name(F.col("service")),
            "host": S.norm_name(F.col("host")),
            "request_id": S.norm_ws(F.col("request_id")),
            "trace_id": S.norm_ws(F.col("trace_id")),
            "environment": env,
        }
    )
    names = ("normalized_message", "host", "request_id", "trace_id", "environment")
    payload = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return out.withColumn("normalized_data", _without_nulls(payload))


def records_to_events(df: DataFrame, source: str, source_type: str = "file") -> DataFrame:
    """Parsed or normalized records as canonical log events."""
    return df.withColumns(
        {
            "event_type": F.lit("LOG"),
            "source": F.lit(source),
            "source_type": F.lit(source_type),
            "source_id": F.lit(None).cast("string"),
        }
    )


def normalize_events(df: DataFrame) -> DataFrame:
    """Clean canonical log events; rows of other kinds pass through."""
    is_log = F.col("event_type") == "LOG"
    message = S.norm_ws(F.col("message"))
    pattern = S.message_pattern(F.col("message"))
    host = S.norm_name(F.col("host"))
    own = F.coalesce(F.col("normalized_data"), F.create_map().cast("map<string,string>"))
    extra = F.create_map(F.lit("normalized_message"), pattern, F.lit("host"), host)
    merged = _without_nulls(F.map_concat(own, extra))
    new = {
        "message": F.coalesce(message, F.col("message")),
        "service": S.norm_name(F.col("service")),
        "host": host,
        "request_id": S.norm_ws(F.col("request_id")),
        "trace_id": S.norm_ws(F.col("trace_id")),
        "environment": S.norm_name(F.col("environment")),
        "normalized_data": F.when(F.size(merged) > 0, merged),
    }
    return df.withColumns({c: F.when(is_log, v).otherwise(F.col(c)) for c, v in new.items()})


def float_text(c: Column) -> Column:
    """Shortest decimal form with a fraction, as in ``12.0``."""
    return c.cast("double").cast("string")


def event_message(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    version = S.blank_to_null(F.concat_ws(" ", S.blank_to_null(F.col("version")), S.blank_to_null(F.col("commit_sha"))))
    text = (
        F.when(kind == "LOG", F.col("message"))
        .when(kind == "ALERT", F.col("name"))
        .when(kind == "METRIC", F.concat("metric_name", F.lit("="), float_text(F.col("value"))))
        .when(kind == "DEPLOYMENT", version)
        .when(kind == "TRACE", F.col("operation_name"))
    )
    return df.withColumn("message", text)


KIND_FIELDS = {
    "LOG": ("message", "severity", "host", "request_id", "trace_id"),
    "METRIC": ("metric_name", "value", "unit", "labels"),
    "ALERT": ("name", "status", "severity", "labels", "annotations"),
    "DEPLOYMENT": ("version", "commit_sha", "author", "repository", "changed_files"),
    "TRACE": ("trace_id", "span_id", "parent_span_id", "operation_name", "duration_ms", "status"),
}


def event_payload(df: DataFrame) -> DataFrame:
    """Severity of log and alert only; payload = own map overlaid by kind fields."""
    kind = F.col("event_type")
    types = dict(df.dtypes)

    def as_text(name: str) -> Column:
        simple = types[name] in ("string", "double", "bigint", "int", "boolean")
        return F.col(name).cast("string") if simple else F.to_json(name)

    parts = F.create_map().cast("map<string,string>")
    for event_type, names in KIND_FIELDS.items():
        own = F.create_map(*[x for n in names if n in types for x in (F.lit(n), as_text(n))])
        parts = F.when(kind == event_type, _without_nulls(own)).otherwise(parts)
    own = F.coalesce(F.col("normalized_data"), F.create_map().cast("map<string,string>"))
    payload = F.map_concat(own, parts)
    return df.withColumns(
        {
            "severity": F.when(kind.isin("LOG", "ALERT"), F.col("severity")),
            "normalized_data": F.when(F.size(payload) > 0, payload),
        }
    )


def select_logs(
    df: DataFrame,
    start,
    end,
    service: str | None = None,
    environment: str | None = None,
    severity: str | None = None,
    size: int | None = None,
) -> DataFrame:
    """Logs of a time range by attribute, oldest first; all of them, or the first ``size``."""
    out = df.filter(F.col("timestamp").between(F.lit(start), F.lit(end)))
    if service is not None:
        out = out.filter(F.col("service") == service)
    if environment is not None:
        out = out.filter(F.col("environment") == environment)
    if severity is not None:
        out = out.filter(F.lower("severity").isin(*X.FILTER_TOKENS[severity]))
    out = out.orderBy("timestamp")
    return out if size is None else out.limit(size)
