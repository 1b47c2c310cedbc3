"""Timeline entries of many incidents at once, and their markers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import DAY
from faultline.functions import scores as C
from faultline.operators.asof import Target, next_targets
from faultline.operators.slices import counts_within, equal_slices, positions, running_total
from faultline.session import cut

ENTRY_COLUMNS = {
    "incident_id": "bigint",
    "id": "string",
    "category": "string",
    "timestamp": "timestamp",
    "title": "string",
    "summary": "string",
    "severity": "string",
    "event_id": "bigint",
    "error_group_id": "bigint",
    "service_id": "bigint",
    "metric_name": "string",
    "value": "double",
    "status": "string",
    "trace_id": "string",
    "span_id": "string",
    "parent_span_id": "string",
    "repository": "string",
    "version": "string",
    "changed_files": "array<string>",
    "occurrence_count": "bigint",
    "incident_started_at": "timestamp",
}
FOREVER = 1 << 62
PAIRS_PER_TASK = 4_000_000
MARKERS = ("first_anomaly", "first_relevant_error", "first_alert", "recent_deployment", "recovery")


def windows(incidents: DataFrame, now: datetime | Column, lookback_us: int = DAY) -> DataFrame:
    """Incidents with the bounds in which their evidence is collected."""
    end = F.coalesce(F.col("ended_at"), now if isinstance(now, Column) else F.lit(now))
    start = F.timestamp_micros(F.unix_micros("started_at") - lookback_us)
    return incidents.withColumns({"window_start": start, "window_end": end})


def _bucket(ts: str, width: int) -> Column:
    return F.floor(F.unix_micros(ts) / width)


def incident_events(
    incidents: DataFrame, events: DataFrame, now, lookback_us: int = DAY, bucket_us: int = DAY
) -> DataFrame:
    """Each incident with the events of its window, service and environment.

    The range condition becomes an equi join on (project, time bucket): an
    incident is listed under each bucket it covers, an event under its own,
    so each pair meets once. Events without a service or environment match
    any. Which side is broadcast is left to the measured sizes.
    """
    w = windows(incidents, now, lookback_us)
    spans = w.select(
        F.col("id").alias("incident_id"),
        F.col("project_id").alias("_project"),
        F.col("service_id").alias("_service"),
        F.col("environment").alias("_environment"),
        "window_start",
        "window_end",
        F.col("started_at").alias("incident_started_at"),
        F.explode(F.sequence(_bucket("window_start", bucket_us), _bucket("window_end", bucket_us))).alias("_b"),
    )
    ev = events.withColumn("_eb", _bucket("timestamp", bucket_us))
    inside = F.col("timestamp").between(F.col("window_start"), F.col("window_end"))
    environment = (
        F.coalesce(F.col("_environment") == "", F.lit(True))
        | F.col("environment").isNull()
        | (F.col("environment") == F.col("_environment"))
    )
    service = F.col("_service").isNull() | F.col("service_id").isNull() | (F.col("service_id") == F.col("_service"))
    on = (F.col("project_id") == F.col("_project")) & (F.col("_eb") == F.col("_b")) & inside & environment & service
    return ev.join(spans, on).drop(
        "_eb", "_b", "_project", "_service", "_environment", "window_start", "window_end"
    )


def incident_groups(
    incidents: DataFrame, groups: DataFrame, now, lookback_us: int = DAY, bucket_us: int = 7 * DAY
) -> DataFrame:
    """Each incident with the error groups seen in its window.

    Both intervals are listed under the buckets they cover; a pair is kept
    in the first bucket they share.
    """
    w = windows(incidents, now, lookback_us).select(
        F.col("id").alias("incident_id"),
        F.col("project_id").alias("_project"),
        F.col("service_id").alias("_service"),
        "window_start",
        "window_end",
        F.col("started_at").alias("incident_started_at"),
    )
    w = w.withColumn("_first", _bucket("window_start", bucket_us)).withColumn(
        "_b", F.explode(F.sequence(F.col("_first"), _bucket("window_end", bucket_us)))
    )
    g = groups.withColumn("_gfirst", _bucket("first_seen", bucket_us)).withColumn(
        "_gb", F.explode(F.sequence(F.col("_gfirst"), _bucket("last_seen", bucket_us)))
    )
    on = (
        (F.col("project_id") == F.col("_project"))
        & (F.col("_gb") == F.col("_b"))
        & (F.col("_b") == F.greatest("_first", "_gfirst"))
        & (F.col("first_seen") <= F.col("window_end"))
        & (F.col("last_seen") >= F.col("window_start"))
        & (F.col("_service").isNull() | F.col("service_id").isNull() | (F.col("service_id") == F.col("_service")))
    )
    return g.join(w, on).drop("_gb", "_gfirst", "_b", "_first", "_project", "_service", "window_start", "window_end")


def _conform(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c)
            for c, t in ENTRY_COLUMNS.items()
        ]
    )


def events_to_entries(events: DataFrame) -> DataFrame:
    """Matched events as timeline entries; ``id`` and ``message`` come from the event row."""
    titled = F.concat(F.initcap(F.lower("event_type")), F.lit(" from "), F.col("source"))
    return _conform(
        events.withColumns(
            {
                "event_id": F.col("id"),
                "id": F.concat(F.lit("event:"), F.col("id").cast("string")),
                "category": F.lower("event_type"),
                "title": F.coalesce(F.nullif(F.col("message"), F.lit("")), titled),
                "summary": F.col("message"),
            }
        )
    )


def iso_text(c: Column) -> Column:
    """UTC time as ISO text; the fraction appears only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit("+00:00"))


def groups_to_entries(groups: DataFrame) -> DataFrame:
    summary = F.concat(
        F.lit("seen "), F.col("occurrence_count").cast("string"), F.lit(" times; last at "), iso_text(F.col("last_seen"))
    )
    return _conform(
        groups.withColumns(
            {
                "error_group_id": F.col("id"),
                "id": F.concat(F.lit("error_group:"), F.col("id").cast("string")),
                "category": F.lit("error"),
                "timestamp": F.col("first_seen"),
                "title": F.col("normalized_message"),
                "summary": summary,
            }
        )
    )


def build_entries(matched_events: DataFrame, matched_groups: DataFrame) -> DataFrame:
    """Entries of events, plus groups that no event of the incident refers to."""
    ev = events_to_entries(matched_events)
    seen = ev.filter(F.col("error_group_id").isNotNull()).select("incident_id", "error_group_id").distinct()
    fresh = groups_to_entries(matched_groups).join(seen, ["incident_id", "error_group_id"], "left_anti")
    return ev.unionByName(fresh)


@dataclass(frozen=True)
class SharedEntries:
    """Entries of many incidents, with an event held once per scope instead of once per incident.

    ``events`` are entries whose ``incident_id`` is a scope: incidents of one project,
    service and environment. ``spans`` (incident_id, scope, window_start, window_end,
    incident_started_at) say what part of its scope is an incident's, and ``groups``
    are entries of the incidents themselves.
    """

    events: DataFrame
    spans: DataFrame
    groups: DataFrame

    def placed(self) -> PlacedEntries:
        """The same with the places of events in their scope; rows of all three are written once."""
        sliced, _ = equal_slices(cut(self.events.withColumnRenamed("incident_id", "scope").drop("incident_started_at")), ["scope"], "timestamp")
        ranked = positions(sliced, ["scope"], ["_slice"], ["timestamp", "id"], "_at")
        events = cut(ranked.withColumn("_at", F.col("_at") - 1).drop("_slice"))
        bounds = (("window_start", 0, "_from"), ("window_end", 2, "_upto"))
        points = [self.spans.select("scope", F.col(c).alias("timestamp"), F.lit(side).alias("_side")) for c, side, _ in bounds]
        at = _places(events, points[0].unionByName(points[1]))
        spans = self.spans
        for c, side, place in bounds:
            own = at.filter(F.col("_side") == side).select("scope", F.col("timestamp").alias(c), F.col("_place").alias(place))
            spans = spans.join(own, ["scope", c])
        return PlacedEntries(events, cut(spans), cut(self.groups))

    def seen(self) -> DataFrame:
        """``events`` with ``seen``: how many incidents an entry belongs to, where any."""
        times = self.events.select(F.col("incident_id").alias("scope"), "timestamp").distinct()
        line = times.select("scope", "timestamp", F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_n"))
        for at, side, step in (("window_start", 0, 1), ("window_end", 2, -1)):
            ends = self.spans.groupBy("scope", F.col(at).alias("timestamp")).agg((F.count(F.lit(1)) * step).alias("_n"))
            line = line.unionByName(ends.withColumn("_side", F.lit(side)))
        sliced, _ = equal_slices(cut(line), ["scope"], "timestamp")
        at = running_total(sliced, ["scope"], ["_slice"], ["timestamp", "_side"], F.col("_n"), "seen").filter("_side = 1 and seen > 0")
        return self.events.join(at.select(F.col("scope").alias("incident_id"), "timestamp", "seen"), ["incident_id", "timestamp"])

    def after(self, sources: DataFrame, wanted: Column) -> DataFrame:
        """Entries named by ``sources`` (incident_id, id), the first of ``wanted`` after each in its incident, and all of ``groups``.

        First ones come once for each source and span; of those at one time and id all.
        """
        columns = self.events.columns
        rows = self.events.withColumnRenamed("incident_id", "scope").drop("incident_started_at")
        span = F.struct(*self.spans.columns).alias("_span")
        inside = F.col("timestamp").between(F.col("_span.window_start"), F.col("_span.window_end"))
        asked = self.spans.join(sources.select("incident_id", "id").distinct(), "incident_id").select("scope", "id", span)
        named = cut(rows.join(asked, ["scope", "id"]).filter(inside))
        times = named.select("_span.incident_id", "timestamp").distinct()
        start = F.timestamp_micros(F.unix_micros("window_start") - 1)
        points = self.spans.join(times, "incident_id").filter(F.col("timestamp") < F.col("window_end"))
        points = points.select("scope", F.greatest("timestamp", start).alias("timestamp"), span)
        marked = rows.select("scope", "timestamp", "id", wanted.alias("_hit")).filter("_hit")
        line = cut(marked.unionByName(points, allowMissingColumns=True))
        found = next_targets(line, ["scope"], {"_next": Target(F.col("_hit"), FOREVER)}).filter("_span is not null and _next is not null")
        keyed = found.select("_span", "scope", F.timestamp_micros("_next.us").alias("timestamp"), F.col("_next.id").alias("id"))
        keyed = keyed.filter(inside).alias("k")
        on = [F.col(f"e.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("scope", "timestamp", "id")]
        hits = rows.alias("e").join(keyed, on).select("e.*", "k._span")
        both = named.unionByName(hits).withColumns({c: F.col(f"_span.{c}") for c in ("incident_id", "incident_started_at")})
        return both.select(*columns).unionByName(self.groups.select(*columns))

    def counts(self, column: str) -> DataFrame:
        """(incident_id, column, n): each incident's entries by a column, where any."""
        rows = self.events.withColumnRenamed("incident_id", "scope").select("scope", column, "timestamp")
        values = rows.select("scope", column).distinct()
        found = counts_within(rows, self.spans.join(values, "scope"), ["scope", column])
        own = self.groups.groupBy("incident_id", column).agg(F.count(F.lit(1)).alias("n"))
        every = found.select("incident_id", column, "n").unionByName(own)
        return every.groupBy("incident_id", column).agg(F.sum("n").alias("n"))

    def ends(self, first: dict[str, Column], last: dict[str, Column], last_by: Column) -> DataFrame:
        """Entries, for each incident, that hold its first of each condition in ``first`` and the last of each in ``last``.

        Last ones are taken up to ``last_by``, a time of the span. Entries come once or more, those of groups all.
        """
        rows = self.events.withColumnRenamed("incident_id", "scope").drop("incident_started_at")
        span = F.struct(*self.spans.columns).alias("_span")
        hits = None
        for conditions, at, ahead in ((first, F.col("window_start"), True), (last, F.least("window_end", last_by), False)):
            wanted = rows.withColumns({f"_{n}": F.coalesce(c, F.lit(False)) for n, c in conditions.items()})
            flags = [f"_{n}" for n in conditions]
            marked = wanted.select("scope", "timestamp", "id", *flags).filter(F.array_contains(F.array(*flags), True))
            line = cut(marked.unionByName(self.spans.select("scope", at.alias("timestamp"), span), allowMissingColumns=True))
            targets = {n: Target(F.col(f"_{n}"), FOREVER, strict=False) for n in conditions}
            found = next_targets(line, ["scope"], targets, ahead=ahead).filter(F.col("_span").isNotNull())
            each = found.select("_span", F.explode(F.array_distinct(F.array_compact(F.array(*conditions)))).alias("_h"))
            hits = each if hits is None else hits.unionByName(each)
        inside = hits.withColumn("_at", F.timestamp_micros("_h.us")).filter(F.col("_at").between(F.col("_span.window_start"), F.col("_span.window_end")))
        keyed = inside.select(
            "_span.incident_id", "_span.incident_started_at", F.col("_span.scope").alias("_scope"), "_at", F.col("_h.id").alias("_id")
        ).distinct()
        on = (F.col("scope") == F.col("_scope")) & (F.col("timestamp") == F.col("_at")) & F.col("id").eqNullSafe(F.col("_id"))
        return rows.join(keyed, on).select(*self.events.columns).unionByName(self.groups.select(*self.events.columns))


def _places(events: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (scope, timestamp, _side), each once, with ``_place``: how many events of the scope are before, of ``_side`` 2 also at, that time."""
    times = events.groupBy("scope", "timestamp").agg(F.count(F.lit(1)).alias("_n")).withColumn("_side", F.lit(1))
    line = times.unionByName(points.distinct().withColumn("_n", F.lit(0).cast("bigint")))
    sliced, _ = equal_slices(cut(line), ["scope"], "timestamp")
    at = running_total(sliced, ["scope"], ["_slice"], ["timestamp", "_side"], F.col("_n"), "_place")
    return cut(at.filter("_side <> 1").select("scope", "timestamp", "_side", "_place"))


@dataclass(frozen=True)
class PlacedEntries:
    """Shared entries whose events know their place.

    ``events`` have ``scope`` and ``_at``, their 0-based place in it by (timestamp, id). ``spans``
    hold the places from ``_from`` to before ``_upto``. ``groups`` are entries of incidents: error
    groups, and all entries of incidents that have no span.
    """

    events: DataFrame
    spans: DataFrame
    groups: DataFrame

    def beside(self) -> DataFrame:
        """``groups`` of incidents with a span, with ``scope`` and the bounds of it."""
        return self.groups.drop("incident_started_at").join(self.spans, "incident_id")

    def apart(self) -> DataFrame:
        """``groups`` of incidents without a span."""
        return self.groups.join(self.spans.select("incident_id"), "incident_id", "left_anti")

    def places(self, points: DataFrame) -> DataFrame:
        return _places(self.events, points)

    def pairs(self, rows: DataFrame, parts: DataFrame) -> DataFrame:
        """``rows`` (scope, _at) of every one of ``parts`` (scope, _from, _upto) that holds their place, with all columns of both.

        Both sides meet on stretches of places shorter than most parts, so nearly all
        candidates are results, a dense hour is many keys, and no pair is shuffled.
        """
        some = parts.filter("_from < _upto")
        n, total = some.agg(F.count(F.lit(1)), F.sum(F.col("_upto") - F.col("_from"))).first()
        width = max(64, min(4096, (total or 0) // max(n, 1) // 4))
        tasks = max(1, (total or 0) // PAIRS_PER_TASK, rows.sparkSession.sparkContext.defaultParallelism)
        listed = some.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_upto") - 1) / width))))
        left = rows.withColumn("_b", F.floor(F.col("_at") / width)).repartition(tasks, "scope", "_b")
        both = left.join(listed.repartition(tasks, "scope", "_b").hint("merge"), ["scope", "_b"])
        return both.filter("_at >= _from and _at < _upto").drop("_b")

    def cuts(self, own: DataFrame, side: int) -> DataFrame:
        """Spans cut at the times of ``own`` (incident_id, scope, timestamp, _own): ``_own`` is the least of the first time not before a part.

        A part's events are before that time, with ``_side`` 2 also at it; after the last time ``_own`` is null.
        """
        times = own.groupBy("incident_id", "scope", "timestamp").agg(F.min("_own").alias("_own"))
        at = self.places(times.select("scope", "timestamp", F.lit(side).alias("_side")))
        placed = times.join(at, ["scope", "timestamp"]).join(self.spans.select("incident_id", "_from", "_upto"), "incident_id")
        place = F.greatest("_from", F.least("_upto", "_place")).alias("_place")
        stops = placed.select("incident_id", place, "timestamp", "_own")
        ends = self.spans.select("incident_id", F.col("_upto").alias("_place"))
        every = stops.unionByName(ends, allowMissingColumns=True)
        w = Window.partitionBy("incident_id").orderBy("_place", F.asc_nulls_last("timestamp"))
        parts = every.withColumn("_before", F.lag("_place").over(w)).drop("timestamp").join(self.spans, "incident_id")
        return cut(parts.withColumns({"_from": F.coalesce("_before", "_from"), "_upto": F.col("_place")}).drop("_before", "_place"))


def share_entries(
    incidents: DataFrame, events: DataFrame, groups: DataFrame, now, lookback_us: int = DAY, bucket_us: int = DAY
) -> SharedEntries:
    """The entries of ``build_entries``, held by scope.

    Each time bucket that a window of a scope touches takes its events once,
    however many incidents of that scope share it, by ``incident_events``.
    """
    keys = ["project_id", "service_id", "environment"]
    w = windows(incidents, now, lookback_us).filter(F.col("project_id").isNotNull() & (F.col("window_start") <= F.col("window_end")))
    w = w.withColumn("environment", F.nullif("environment", F.lit("")))
    scopes = cut(w.select(*keys).distinct().withColumn("scope", F.monotonically_increasing_id()))
    named = scopes.select("scope", *[F.col(k).alias(f"_{k}") for k in keys])
    spans = cut(
        w.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(
            F.col("id").alias("incident_id"), "scope", "window_start", "window_end", F.col("started_at").alias("incident_started_at")
        )
    )
    touched = F.explode(F.sequence(_bucket("window_start", bucket_us), _bucket("window_end", bucket_us)))
    parts = spans.select("scope", touched.alias("_b")).distinct().join(scopes, "scope")
    bounds = {"started_at": F.timestamp_micros(F.col("_b") * bucket_us), "ended_at": F.timestamp_micros((F.col("_b") + 1) * bucket_us - 1)}
    matched = incident_events(parts.withColumns({"id": F.col("scope"), **bounds}), events, now, 0, bucket_us)
    rows = events_to_entries(matched)
    listed = incident_groups(incidents, groups, now, lookback_us)
    wanted = listed.select("incident_id", F.col("id").alias("error_group_id")).distinct()
    named_rows = rows.filter(F.col("error_group_id").isNotNull()).withColumnRenamed("incident_id", "scope")
    seen = counts_within(named_rows, spans.join(wanted, "incident_id"), ["scope", "error_group_id"])
    keyed = seen.select("incident_id", "error_group_id")
    fresh = groups_to_entries(listed).join(keyed, ["incident_id", "error_group_id"], "left_anti")
    return SharedEntries(rows, spans, fresh)


def order_entries(entries: DataFrame) -> DataFrame:
    return entries.orderBy("incident_id", "timestamp", "id")


def category_counts(entries: DataFrame | SharedEntries) -> DataFrame:
    if isinstance(entries, SharedEntries):
        return entries.counts("category")
    return entries.groupBy("incident_id", "category").agg(F.count(F.lit(1)).alias("n"))


def markers(entries: DataFrame | SharedEntries, incidents: DataFrame, lookback_us: int = DAY) -> DataFrame:
    """One row per incident with its five marker structs, null where absent.

    All markers come from one aggregation with map-side partials. Of shared
    entries, only those at the ends of a window's kinds come to it.
    """
    if isinstance(entries, SharedEntries):
        category, severity = F.col("category"), F.col("severity")
        first = {
            "anomaly": C.is_anomaly(category, severity),
            "error": category == "error",
            "log": C.is_error(category, severity) & (category == "log"),
            "alert": category == "alert",
            "resolved": C.is_resolved(category, F.col("status")),
        }
        entries = entries.ends(first, {"deployment": category == "deployment"}, F.col("incident_started_at"))
    body = F.struct(
        "id",
        "category",
        "timestamp",
        "title",
        "summary",
        "severity",
        "event_id",
        "error_group_id",
        "service_id",
        "repository",
        "version",
        "changed_files",
    )
    at = F.struct("timestamp", "id")
    category, severity = F.col("category"), F.col("severity")
    start_us, us = F.unix_micros("incident_started_at"), F.unix_micros("timestamp")

    def first(cond: Column) -> Column:
        return F.min_by(F.when(cond, body), F.when(cond, at))

    recent = (category == "deployment") & us.between(start_us - lookback_us, start_us)
    agg = entries.groupBy("incident_id").agg(
        first(C.is_anomaly(category, severity)).alias("first_anomaly"),
        first(category == "error").alias("_error"),
        first(C.is_error(category, severity) & (category == "log")).alias("_log"),
        first(category == "alert").alias("first_alert"),
        F.max_by(F.when(recent, body), F.when(recent, at)).alias("recent_deployment"),
        first(C.is_resolved(category, F.col("status"))).alias("_resolved"),
    )
    closed = F.col("ended_at").isNotNull() & F.col("incident_status").isin("RESOLVED", "CLOSED")
    null = F.lit(None)
    ended = F.struct(
        F.concat(F.lit("incident:"), F.col("incident_id").cast("string"), F.lit(":recovery")).alias("id"),
        F.lit("alert").alias("category"),
        F.col("ended_at").alias("timestamp"),
        F.lit("Incident resolved").alias("title"),
        F.concat(F.lit("Incident marked "), F.lower("incident_status")).alias("summary"),
        null.cast("string").alias("severity"),
        null.cast("bigint").alias("event_id"),
        null.cast("bigint").alias("error_group_id"),
        null.cast("bigint").alias("service_id"),
        null.cast("string").alias("repository"),
        null.cast("string").alias("version"),
        null.cast("array<string>").alias("changed_files"),
    )
    # A resolved alert never precedes the first alert, as it is an alert itself.
    base = incidents.select(
        F.col("id").alias("incident_id"),
        "project_id",
        F.col("service_id").alias("incident_service_id"),
        F.col("started_at").alias("incident_started_at"),
        "ended_at",
        F.col("status").alias("incident_status"),
    )
    return base.join(agg, "incident_id", "left").select(
        *base.columns,
        "first_anomaly",
        F.coalesce("_error", "_log").alias("first_relevant_error"),
        "first_alert",
        "recent_deployment",
        F.when(closed, ended).otherwise(F.col("_resolved")).alias("recovery"),
    )
