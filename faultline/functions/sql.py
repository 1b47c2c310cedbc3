"""SQL access to the scalar operators, as SQL functions over built-ins."""

from __future__ import annotations

from pyspark.sql import SparkSession

from faultline.functions import fields as X
from faultline.functions import text as S


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern_body(arg: str) -> str:
    body = f"nullif(trim(regexp_replace({arg}, {_quoted(S.WHITESPACE)}, ' ')), '')"
    rules = (
        ("(?iU)" + S.UUID, "uuid"),
        ("(?iU)" + S.IPV6, "ip"),
        ("(?U)" + S.IPV4, "ip"),
        ("(?U)" + S.ISO_TIME, "timestamp"),
        ("(?iU)" + S.HEX_HASH, "hash"),
        ("(?iU)" + S.REQUEST_ID, "request_id"),
        ("(?U)" + S.NUMBER, "id"),
    )
    for pattern, token in rules:
        body = f"regexp_replace({body}, {_quoted(pattern)}, {_quoted(chr(92) + '{' + token + chr(92) + '}')})"
    return body


def _case(values: dict[str, str], arg: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE lower(trim({arg})) {arms} END"


def register_sql_functions(spark: SparkSession) -> None:
    """Create message_pattern, parse_severity, lag_score and event_fingerprint."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION message_pattern(message STRING) RETURNS STRING RETURN {_pattern_body('message')}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION parse_severity(token STRING) RETURNS STRING "
        f"RETURN {_case(X.SEVERITY_TOKENS, 'token')}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION lag_score(lag_us BIGINT, max_us BIGINT) RETURNS DOUBLE "
        "RETURN CASE WHEN lag_us >= 0 AND lag_us <= max_us AND max_us > 0 "
        "THEN 1.0D - CAST(lag_us AS DOUBLE) / max_us ELSE 0.0D END"
    )
    material = (
        "to_json(named_struct('event_type', coalesce(trim(event_type), ''), "
        "'normalized_message', coalesce(trim(pattern), ''), "
        f"'service', coalesce(lower(nullif(trim(regexp_replace(service, {_quoted(S.WHITESPACE)}, ' ')), '')), ''), "
        "'severity', coalesce(trim(severity), ''), 'source', coalesce(trim(source), '')), "
        "map('writeNonAsciiCharacterAsCodePoint', 'true'))"
    )
    escape = _quoted(chr(92) * 2 + "u(?=[0-9A-Fa-f]{4})")
    # between escaped backslashes, however many, every \\u is an escape
    pieces = (
        f"array_join(transform(split(part, {escape}), (p, i) -> CASE WHEN i = 0 THEN p "
        "ELSE concat(lower(substring(p, 1, 4)), substring(p, 5)) END), r'\\u')"
    )
    lowered = f"array_join(transform(split({material}, {_quoted(chr(92) * 4)}), part -> {pieces}), r'\\\\')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION event_fingerprint("
        "event_type STRING, source STRING, service STRING, severity STRING, pattern STRING) RETURNS STRING "
        f"RETURN sha2({lowered}, 256)"
    )
