"""Entries held by scope give what entries held by incident give."""

import datetime as dt
import functools

import pytest
from pyspark.sql import functions as F

from faultline.operators import anomaly, correlate, evidence, services, slices, timeline
from faultline.operators.asof import Target, next_targets

METRIC = "if(event_type = 'METRIC' and id % 50 <> 8, {}, null)"
NOW = dt.datetime(2024, 1, 6, tzinfo=dt.timezone.utc)
EVENT = (
    "id long, project_id long, service_id long, event_type string, timestamp timestamp, environment string, source string, "
    "severity string, message string, status string, error_group_id long, repository string, version string"
)
INCIDENT = "id long, project_id long, service_id long, environment string, status string, started_at timestamp, ended_at timestamp"
GROUP = (
    "id long, project_id long, service_id long, normalized_message string, severity string, occurrence_count long, "
    "first_seen timestamp, last_seen timestamp"
)
KINDS = ("LOG", "METRIC", "ALERT", "DEPLOYMENT", "TRACE", None)


def at(minute):
    return dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def tables(spark):
    events = [
        (
            i if i != 77 else 76, None if i % 31 == 30 else 1 + i % 2, None if i % 3 == 0 else i % 4, KINDS[i % 6], None if i == 40 else at(i * 7 % 2800 // 30 * 30),
            (None, "a", "b")[i % 3 if i % 5 else 0], "stream", ("HIGH", "LOW", None)[i % 3], f"m{i}",
            "RESOLVED" if i % 4 == 0 else "FIRING", 100 + i % 3 if i % 6 == 0 else None, "r", f"v{i}",
        )
        for i in range(300)
    ]
    incidents = [
        (
            None if i == 8 else i if i != 5 else 4, None if i == 9 else 1 + i % 2, None if i % 3 == 0 else i % 4, ("a", "b", "", None)[i % 4],
            "RESOLVED" if i % 4 == 1 else "OPEN", None if i == 11 else at(i * 60), None if i % 6 == 0 else at(i * 60 + (-3000 if i == 7 else 180)),
        )
        for i in range(40)
    ]
    groups = [(100 + i, 1 + i % 2, None if i % 2 else i, f"g{i}", "HIGH", 5, at(i * 100), at(i * 100 + 900)) for i in range(4)]
    names = spark.createDataFrame([(0, "s0"), (1, "s1"), (1, "s1b"), (2, "s2")], "id long, name string")
    return (
        spark.createDataFrame(incidents, INCIDENT),
        spark.createDataFrame(events, EVENT),
        spark.createDataFrame(groups, GROUP),
        names,
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts_services_and_markers_equal_those_of_pairs(spark, monkeypatch):
    from faultline.plans import timelines as TL

    monkeypatch.setattr(slices, "equal_slices", functools.partial(slices.equal_slices, rows_per_slice=5))
    t = tables(spark)
    plain = TL.timeline_entries(*[x.withColumns({"metric_name": F.lit("m"), "value": F.lit(1.0)}) if i == 1 else x for i, x in enumerate(t)], NOW)
    plain = timeline.cut(plain)
    shared = TL.shared_entries(*t, NOW)
    assert rows(timeline.category_counts(shared)) == rows(timeline.category_counts(plain))
    assert rows(services.involved_services(shared)) == rows(services.involved_services(plain))
    shown = ["incident_id"] + [f"{m}.{c}" for m in timeline.MARKERS for c in ("id", "timestamp", "title")]
    one, two = (timeline.markers(e, t[0]).filter("incident_id <> 4 or incident_id is null").select(*shown) for e in (shared, plain))
    assert rows(one) == rows(two)


def test_an_event_is_held_once_however_many_incidents_see_it(spark):
    incidents = spark.createDataFrame([(i, 1, None, "a", "OPEN", at(600), at(700)) for i in range(200)], INCIDENT)
    events = spark.createDataFrame(
        [(i, 1, 1, "LOG", at(i), None, "stream", "HIGH", "m", None, None, None, None) for i in range(50)], EVENT
    )
    groups = spark.createDataFrame([], GROUP)
    shared = timeline.share_entries(incidents, events, groups, NOW)
    assert shared.events.count() == 50
    assert [tuple(r) for r in timeline.category_counts(shared).select("category", "n").distinct().collect()] == [("log", 50)]


@pytest.mark.parametrize("slice_rows", [4, 1000])
def test_latest_earlier_target(spark, slice_rows):
    data = [(i % 2, f"e{i:02d}", at(i * 13 % 20), i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(data, "k long, id string, timestamp timestamp, hit boolean")
    limit = 5 * 60_000_000
    found = next_targets(df, ["k"], {"h": Target(F.col("hit"), limit, strict=False)}, slice_rows=slice_rows, ahead=False)
    got = {r["id"]: r["h"] and r["h"]["id"] for r in found.collect()}
    for k, i, ts, _ in data:
        near = [(b, j) for kk, j, b, hit in data if kk == k and hit and (b < ts or (b == ts and j != i))]
        best = max(near) if near else None
        want = best[1] if best and ts - best[0] <= dt.timedelta(minutes=5) else None
        assert got[i] in {want} | ({j for b, j in near if b == ts and j < i} if best and best[0] == ts else set()), (i, got[i], want)


def test_links_of_recent_deployments_equal_those_of_pairs(spark, monkeypatch):
    from faultline.plans import timelines as TL

    monkeypatch.setattr(slices, "equal_slices", functools.partial(slices.equal_slices, rows_per_slice=5))
    t = list(tables(spark))
    anywhere = {c: F.expr(f"if(id % 7 = 0, {c}, null)") for c in ("service_id", "environment")}
    t[1] = t[1].withColumns({"metric_name": F.lit("m"), "value": F.lit(1.0), "project_id": F.expr("1 + id div 6 % 2"), **anywhere})
    t[1] = t[1].unionByName(t[1].filter("id % 12 = 3"))  # deployments that come twice
    plain = timeline.cut(TL.timeline_entries(*t, NOW))
    shared = TL.shared_entries(*t, NOW)
    monkeypatch.setattr(TL.timeline, "incident_events", None)  # nothing pairs incidents and events any more
    marks = timeline.cut(timeline.markers(shared, t[0]))
    named = marks.selectExpr("incident_id", "recent_deployment.id as source_id").distinct()
    links = correlate.correlate_temporal(plain).filter("kind = 'deployment_to_error'").join(named, ["incident_id", "source_id"])
    found = correlate.deployment_links(shared, marks).select(*links.columns)
    assert rows(found) == rows(links)
    assert links.count() > 10


def metrics(spark, step):
    """Tables with dense series: values vary, times tie, some values and names are missing."""
    t = list(tables(spark))
    anywhere = {c: F.expr(f"if(id % 7 = 0, {c}, null)") for c in ("service_id", "environment")}
    value = F.expr(METRIC.format("pmod(hash(id), 23) * 1.0D"))
    name = F.expr("if(id % 4 = 0, concat('m', id % 8), if(id % 4 = 1, '', null))")
    kind = F.expr("if(id % 4 <> 3, 'METRIC', event_type)")
    message = F.expr("if(id % 50 = 9, null, concat('m', id % 2))")
    t[1] = t[1].withColumn("event_type", kind).withColumns(
        {"value": value, "metric_name": name, "message": message, "project_id": F.lit(1), "source": F.lit(None).cast("string"), **anywhere}
    )
    t[1] = t[1].withColumn("timestamp", F.timestamp_micros(F.floor(F.unix_micros("timestamp") / (step * 60_000_000)) * (step * 60_000_000)))
    return t


@pytest.mark.parametrize("step, slice_rows", [(1, 5), (90, 1000), (400, 5)])
def test_flags_and_predicates_equal_those_of_pairs(spark, monkeypatch, step, slice_rows):
    from faultline.plans import timelines as TL

    t = metrics(spark, step)
    plain = timeline.cut(TL.timeline_entries(*t, NOW))
    wanted = rows(plain.filter("category = 'metric'").select("incident_id", "id", "timestamp", "anomaly"))
    cut_slices = slices.equal_slices
    for module in (slices, anomaly, timeline):
        monkeypatch.setattr(module, "equal_slices", lambda df, keys, ts, *_: cut_slices(df, keys, ts, slice_rows))
    flags = TL.shared_flags(*t, NOW)
    own, spans = flags.entries.groups, flags.entries.spans.select("incident_id", "scope", "window_start", "window_end")
    shared = flags.entries.events.filter("category = 'metric'").withColumnRenamed("incident_id", "scope").withColumn("_series", anomaly._series())
    each = shared.join(spans, "scope").filter("timestamp between window_start and window_end").withColumnRenamed("anomaly", "whole")
    each = each.join(flags.changes, ["incident_id", "scope", "_series", "timestamp"], "left")
    found = each.selectExpr("incident_id", "id", "timestamp", "coalesce(anomaly, whole) as anomaly").unionByName(
        own.filter("category = 'metric'").select("incident_id", "id", "timestamp", "anomaly")
    )
    assert rows(found) == wanted
    assert flags.changes.count() > 0 and own.filter("incident_id = 4 and category = 'metric'").count() > 0
    assert len({r[-1] for r in wanted}) == 2
    assert rows(anomaly.predicate_counts(flags)) == rows(anomaly.predicate_counts(plain))


def small_slices(monkeypatch, slice_rows, *modules):
    cut_slices = slices.equal_slices
    for module in (slices, timeline, *modules):
        monkeypatch.setattr(module, "equal_slices", lambda df, keys, ts, *_: cut_slices(df, keys, ts, slice_rows))


@pytest.mark.parametrize("slice_rows", [5])
def test_entry_numbers_equal_those_of_pairs(spark, monkeypatch, slice_rows):
    from faultline.plans import timelines as TL

    t = list(tables(spark))
    t[1] = t[1].withColumn("project_id", F.expr("1 + id % 2")).unionByName(t[1].filter("id % 6 = 0"))
    t[2] = t[2].unionByName(t[2].withColumns({"id": F.expr("id + 50"), "first_seen": F.timestamp_micros(F.unix_micros("first_seen") + 60_000_000)}))
    pairs = timeline.build_entries(timeline.incident_events(*t[:2], NOW), timeline.incident_groups(t[0], t[2], NOW))
    shown = ("incident_id", "id", "timestamp", "incident_started_at", "entry_index")  # two rows of id 76 share their time
    wanted = evidence.number_entries(pairs).select(*shown)
    own = wanted.filter("id like 'error_group:%'")
    assert own.filter("entry_index > 0").count() > 10 and own.count() > own.filter("entry_index > 0").count()
    small_slices(monkeypatch, slice_rows)
    found = evidence.number_entries(TL.unique_entries(*t[:3], NOW))
    assert rows(found.select(*shown)) == rows(wanted)


@pytest.mark.parametrize("step, slice_rows", [(1, 5)])
def test_flagged_metrics_equal_those_of_pairs(spark, monkeypatch, step, slice_rows):
    from faultline.plans import timelines as TL

    t = metrics(spark, step)
    shown = ("incident_id", "id", "timestamp", "service_name", "incident_started_at", "anomaly")
    wanted = rows(TL.timeline_entries(*t, NOW).filter("category = 'metric'").select(*shown))
    small_slices(monkeypatch, slice_rows, anomaly)
    assert rows(TL.shared_flags(*t, NOW).flagged().select(*shown)) == wanted


def linked(spark, step):
    """Dense series with errors, alerts and deployments between them, in few traces; error groups stand among the events."""
    t = metrics(spark, step)
    kind = F.expr("if(id % 4 < 2, 'METRIC', element_at(array('LOG', 'ALERT', 'DEPLOYMENT', 'TRACE'), 1 + cast(pmod(hash(id, 4), 4) as int)))")
    value = F.expr("if(id % 4 < 2 and id % 50 <> 8, pmod(hash(id), 23) * 1.0D, null)")
    traced = {"trace_id": F.expr("if(id % 20 = 3, '', concat('t', id div 30))"), "status": F.expr("if(id % 5 = 0, 'resolved', 'FIRING')")}
    t[1] = t[1].withColumns({"event_type": kind, "value": value, "severity": F.lit("HIGH"), **traced})
    t[1] = t[1].withColumn("message", F.expr("coalesce(message, 'x')")).unionByName(t[1].filter("id % 30 = 2"))
    t[2] = t[2].withColumn("service_id", F.expr("if(id % 2 = 0, null, service_id)")).withColumn("project_id", F.lit(1))
    more = [t[2].withColumns({"id": F.expr(f"id + {100 * k}"), "first_seen": F.timestamp_micros(F.unix_micros("first_seen") + k * 600_000_000)}) for k in range(1, 9)]
    t[2] = functools.reduce(lambda a, b: a.unionByName(b), more, t[2])
    return t


@pytest.mark.parametrize("step, slice_rows", [(30, 7)])
def test_links_and_relations_equal_those_of_pairs(spark, monkeypatch, step, slice_rows):
    from faultline.plans import timelines as TL

    t = linked(spark, step)
    plain = timeline.cut(TL.timeline_entries(*t, NOW))
    steps = (correlate.correlate_temporal, services.service_metric_error, services.attribute_services)
    wanted = [rows(f(plain)) for f in steps]
    traces = rows(services.score_relationships(services.trace_errors(plain)))
    small_slices(monkeypatch, slice_rows, anomaly)
    flags = TL.shared_flags(*t, NOW)
    for f, want in zip(steps, wanted):
        found = f(flags)
        assert rows(found.drop("score") if "evidence" in found.columns else found) == want, f
    found = services.trace_errors(TL.unique_shared(*t, NOW))
    assert rows(services.score_relationships(found)) == traces and len(traces) > 100
    ends = {(r[1], r[2].startswith("error_group"), r[5].startswith("error_group")) for r in wanted[0]}
    assert {k for k, _, target in ends if target} == {"deployment_to_error", "metric_anomaly_to_error"}
    assert any(source for k, source, _ in ends if k == "error_to_alert")
    assert any(r[4].startswith("error_group") for r in wanted[1]) and any(not r[4].startswith("error_group") for r in wanted[1])


@pytest.mark.parametrize("slice_rows, starts", [(3, 4), (1000, 4096)])
def test_dependencies_equal_those_of_pairs(spark, monkeypatch, slice_rows, starts):
    from faultline.plans import timelines as TL

    t = list(tables(spark))
    traced = {
        "event_type": F.expr("if(id % 4 = 0, 'LOG', 'TRACE')"),
        "project_id": F.lit(1),
        "service_id": F.expr("pmod(hash(id), 3)"),
        "environment": F.expr("if(id % 7 = 0, environment, null)"),
        "trace_id": F.expr("if(id % 20 = 3, '', concat('t', pmod(hash(id, 1), 9)))"),
        "span_id": F.expr("if(id % 3 = 0, concat('s', pmod(hash(id, 2), 40)), null)"),  # often given twice, by two services
        "parent_span_id": F.expr("if(id % 2 = 0, concat('s', pmod(hash(id, 3), 40)), ' ')"),
    }
    t[1] = t[1].withColumns(traced)
    t[0] = t[0].withColumn("project_id", F.lit(1)).withColumn("service_id", F.expr("if(id % 5 = 0, service_id, null)"))
    t[3] = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "id long, name string")
    plain = timeline.cut(TL.timeline_entries(*t[:1], t[1].withColumns({"metric_name": F.lit("m"), "value": F.lit(1.0)}), *t[2:], NOW))
    wanted = rows(services.infer_dependencies(plain))
    # Windows short enough that some show an edge that others do not.
    cut_slices = slices.equal_slices
    for module in (slices, services, timeline):
        monkeypatch.setattr(module, "equal_slices", lambda df, keys, ts, *_: cut_slices(df, keys, ts, slice_rows))
    monkeypatch.setattr(services, "STARTS", starts)
    assert rows(TL.shared_dependencies(*t, NOW)) == wanted
    by_incident = {}
    for incident, a, b in wanted:
        by_incident.setdefault(incident, set()).add((a, b))
    assert len(set(map(frozenset, by_incident.values()))) > 2
