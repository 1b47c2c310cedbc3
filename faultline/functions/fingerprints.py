"""SHA-256 fingerprints over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import message_pattern, norm_name

_PAIR = r"\\\\"  # an escaped backslash
_ESCAPE = r"\\u(?=[0-9A-Fa-f]{4})"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and lower-case ASCII escapes."""
    body = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    text = F.to_json(body, {"writeNonAsciiCharacterAsCodePoint": "true"})

    def lowered(part: Column) -> Column:
        pieces = F.transform(
            F.split(part, _ESCAPE),
            lambda p, i: F.when(i == 0, p).otherwise(
                F.concat(F.lower(F.substring(p, F.lit(1), F.lit(4))), F.substring(p, F.lit(5), F.length(p)))
            ),
        )
        return F.array_join(pieces, "\\u")

    # between escaped backslashes, however many, every \\u is an escape
    whole = F.array_join(F.transform(F.split(text, _PAIR), lowered), "\\\\")
    return F.when(F.contains(text, F.lit("\\u")), whole).otherwise(text)


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def event_fingerprint(
    event_type: Column, source: Column, service: Column, severity: Column, normalized_message: Column
) -> Column:
    return F.sha2(
        canonical_json(
            event_type=_text(event_type),
            source=_text(source),
            service=_text(norm_name(service)),
            severity=_text(severity),
            normalized_message=_text(normalized_message),
        ),
        256,
    )


def logical_fingerprint(event_type: Column, service: Column, severity: Column, normalized_message: Column) -> Column:
    """The event fingerprint without its source."""
    return event_fingerprint(event_type, F.lit(""), service, severity, normalized_message)


def log_pattern(message: Column, normalized: Column) -> Column:
    """The stored pattern when there is one, else the pattern of the message."""
    stored = F.trim(normalized)
    return F.when(stored != "", stored).otherwise(message_pattern(message))


def problem_identity(title: Column) -> Column:
    return F.coalesce(message_pattern(title), F.trim(title))


def incident_fingerprint(service_id: Column, environment: Column, title: Column) -> Column:
    return F.sha2(
        canonical_json(
            service_id=_text(service_id.cast("string")),
            environment=F.coalesce(norm_name(environment), F.lower(F.trim(environment)), F.lit("")),
            problem_identity=_text(problem_identity(title)),
        ),
        256,
    )
