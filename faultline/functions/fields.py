"""Field extraction and conversion on maps and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import blank_to_null

# Source names of each common field, first match wins.
ALIASES = {
    "timestamp": ("timestamp", "time", "ts", "@timestamp", "datetime", "date"),
    "severity": ("severity", "level", "log_level", "loglevel", "lvl"),
    "message": ("message", "msg", "log", "text", "body", "error"),
    "service": ("service", "service_name", "app", "application", "component"),
    "host": ("host", "hostname", "node", "server"),
    "request_id": ("request_id", "requestid", "req_id", "correlation_id", "correlationid", "x_request_id"),
    "trace_id": ("trace_id", "traceid", "trace", "span_trace_id"),
}
COMMON_FIELDS = tuple(ALIASES)

# Severity words of logs, of alert labels, and of query filters.
SEVERITY_TOKENS = {
    "trace": "INFO",
    "debug": "INFO",
    "info": "INFO",
    "information": "INFO",
    "low": "LOW",
    "notice": "LOW",
    "warn": "MEDIUM",
    "warning": "MEDIUM",
    "error": "HIGH",
    "err": "HIGH",
    "critical": "CRITICAL",
    "crit": "CRITICAL",
    "fatal": "CRITICAL",
    "emergency": "CRITICAL",
}
LABEL_SEVERITY = {
    "critical": "CRITICAL",
    "error": "HIGH",
    "warning": "HIGH",
    "high": "HIGH",
    "medium": "MEDIUM",
    "low": "LOW",
    "info": "INFO",
    "none": "INFO",
}
FILTER_TOKENS = {
    "INFO": ("info", "information", "debug", "trace"),
    "LOW": ("low", "notice"),
    "MEDIUM": ("medium", "warn", "warning"),
    "HIGH": ("high", "error", "err"),
    "CRITICAL": ("critical", "crit", "fatal", "emergency"),
}

# Line patterns and time formats.
ISO_PREFIX = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
LEVEL_WORD = r"(?iU)\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\b"
KEY_VALUE = r"(?U)(\w+)=('[^']*'|\"[^\"]*\"|\S+)"
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
SLASH_TIME = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"


def _lookup(values: dict[str, str], key: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(mapping, key)


def parse_ts(c: Column) -> Column:
    """Timestamp text to UTC; null when it is no known form.

    Text of digits only is not an epoch here; use ``parse_epoch`` for numbers.
    """
    text = F.trim(c)
    known = text.rlike(ISO_TEXT) | text.rlike(SLASH_TIME)
    return F.when(known, F.try_to_timestamp(F.translate(text, ",/", ".-")))


def parse_epoch(c: Column) -> Column:
    """Epoch seconds, or milliseconds above 1e12, to UTC."""
    seconds = F.when(c > 1e12, c / 1000.0).otherwise(c)
    return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))


def parse_epoch_seconds(c: Column) -> Column:
    """Text of epoch seconds to UTC."""
    return F.timestamp_micros(F.round(c.try_cast("double") * 1e6).cast("bigint"))


def float_value(c: Column) -> Column:
    """Number text as double, with ``NaN``, ``+Inf`` and ``-Inf``."""
    named = F.lower(F.trim(c))
    return (
        F.when(named.isin("+inf", "inf"), F.lit(float("inf")))
        .when(named == "-inf", F.lit(float("-inf")))
        .when(named == "nan", F.lit(float("nan")))
        .otherwise(c.try_cast("double"))
    )


def parse_severity(c: Column) -> Column:
    return _lookup(SEVERITY_TOKENS, F.lower(F.trim(c)))


def normal_keys(m: Column) -> Column:
    """Keys trimmed, lower-cased, dashes to underscores; the last of equals wins."""
    return F.transform_keys(m, lambda k, _: F.replace(F.lower(F.trim(k)), F.lit("-"), F.lit("_")))


def first_alias(m: Column, field: str) -> Column:
    return F.coalesce(*[blank_to_null(F.try_element_at(m, F.lit(a))) for a in ALIASES[field]])


def extract_raw(m: Column, keys: Column | None = None) -> dict[str, Column]:
    """The seven common fields of a map as text, by alias.

    ``keys`` is the map with normal keys, where it exists as a column.
    """
    keys = normal_keys(m) if keys is None else keys
    return {field: first_alias(keys, field) for field in COMMON_FIELDS}


def convert(field: str, c: Column) -> Column:
    if field == "timestamp":
        return parse_ts(c)
    if field == "severity":
        return parse_severity(c)
    return c


def extract_common(m: Column) -> Column:
    return F.struct(*[convert(f, c).alias(f) for f, c in extract_raw(m).items()])


def resolve_column(m: Column, name: str) -> Column:
    """Exact key, else the first key equal without regard to case."""
    matches = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == name.lower())
    fallback = F.when(F.size(matches) > 0, F.try_element_at(matches, F.lit(1))["value"])
    return F.when(F.map_contains_key(m, name), F.try_element_at(m, F.lit(name))).otherwise(fallback)


def apply_mapping(m: Column, mapping: dict[str, str], keys: Column | None = None) -> dict[str, Column]:
    """Common fields where mapped ones replace the automatic ones."""
    unknown = set(mapping) - set(COMMON_FIELDS)
    if unknown or any(not v.strip() for v in mapping.values()):
        raise ValueError(f"bad field mapping: {mapping}")
    auto = extract_raw(m, keys)
    return {
        field: convert(field, resolve_column(m, mapping[field]) if field in mapping else auto[field])
        for field in COMMON_FIELDS
    }


def extract_plain(line: Column) -> dict[str, Column]:
    """Time prefix, first level word and message of an unstructured line.

    The level word is cut out of the message only behind a time prefix.
    """
    whole = F.trim(line)
    prefix = F.regexp_extract(line, ISO_PREFIX, 1)
    has_prefix = prefix != ""
    rest = F.trim(F.substring(line, F.length(prefix) + 1, F.length(line)))
    searched = F.when(has_prefix, rest).otherwise(line)
    level = F.regexp_extract(searched, LEVEL_WORD, 1)
    at = F.regexp_instr(rest, F.lit(LEVEL_WORD))
    without = F.trim(
        F.concat(
            F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + F.length(level), F.length(rest))
        )
    )
    remainder = F.when(level != "", without).otherwise(rest)
    return {
        "timestamp": parse_ts(blank_to_null(prefix)),
        "severity": parse_severity(blank_to_null(level)),
        "message": F.when(has_prefix, F.coalesce(blank_to_null(remainder), whole)).otherwise(whole),
    }


def extract_kv(line: Column) -> Column:
    """Map of key=value pairs; text outside the pairs becomes ``message``."""
    keys = F.regexp_extract_all(line, F.lit(KEY_VALUE), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(KEY_VALUE), F.lit(2))
    stripped = F.transform(values, lambda v: F.regexp_replace(v, "^['\"]+|['\"]+$", ""))
    pairs = normal_keys(F.map_from_arrays(keys, stripped))
    tail = F.trim(F.regexp_replace(line, KEY_VALUE, ""))
    named = F.map_contains_key(pairs, "message") | F.map_contains_key(pairs, "msg")
    return F.when(named | (tail == ""), pairs).otherwise(
        F.map_concat(pairs, F.create_map(F.lit("message"), tail))
    )


def label_severity(m: Column) -> Column:
    raw = F.coalesce(F.try_element_at(m, F.lit("severity")), F.try_element_at(m, F.lit("priority")), F.lit("medium"))
    return F.coalesce(_lookup(LABEL_SEVERITY, F.lower(F.trim(raw))), F.lit("MEDIUM"))


def _first_label(m: Column, *names: str) -> Column:
    return F.coalesce(*[blank_to_null(F.trim(F.try_element_at(m, F.lit(n)))) for n in names])


def label_service(m: Column) -> Column:
    return _first_label(m, "service", "job", "app", "application")


def label_env(m: Column) -> Column:
    return F.coalesce(_first_label(m, "environment", "env"), F.lit("production"))


def label_title(m: Column) -> Column:
    return _first_label(m, "alertname")


def parse_rfc3339(c: Column) -> Column:
    """Time text; blank and the zero time of year 1 become null."""
    parsed = F.try_to_timestamp(blank_to_null(F.trim(c)))
    return F.when(parsed > F.lit("0001-01-01 00:00:00").cast("timestamp"), parsed)
