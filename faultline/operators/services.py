"""Service relations: attribution, traces, dependencies, propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import ServiceThresholds
from faultline.functions import scores as C
from faultline.operators.anomaly import SharedFlags
from faultline.operators.asof import Target, next_targets
from faultline.operators.slices import equal_slices, positions, running_total
from faultline.operators.timeline import SharedEntries
from faultline.session import cut

RELATION_COLUMNS = (
    "incident_id",
    "kind",
    "source_id",
    "source_label",
    "target_id",
    "target_label",
    "evidence",
    "reason",
    "source_entry_id",
    "target_entry_id",
)


def with_service_names(entries: DataFrame, services: DataFrame) -> DataFrame:
    """Entries with ``service_name`` looked up by id in (id, name)."""
    names = services.select(F.col("id").alias("_sid"), F.col("name").alias("service_name"))
    return entries.join(names, F.col("service_id") == F.col("_sid"), "left").drop("_sid")


def _signal(name: str, detail: Column, weight: Column) -> Column:
    return F.struct(F.lit(name).alias("signal"), detail.alias("detail"), weight.cast("double").alias("weight"))


def temporal_signal(lag_us: Column, max_us: int, weight: float) -> Column:
    score = C.lag_score(lag_us, max_us)
    detail = F.format_string(
        "Events separated by %d seconds (temporal score %.2f)", F.floor(lag_us / 1_000_000), score
    )
    return _signal("temporal_proximity", detail, F.round(weight * score, 4))


def same_service_signal(a: Column, b: Column, weight: float) -> Column:
    detail = F.concat(F.lit("Both events attributed to service_id "), a.cast("string"))
    return F.when(a == b, _signal("same_service", detail, F.lit(weight)))


def _relation(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    return df.select("incident_id", _packed(name, **columns).alias("r")).select("incident_id", "r.*")


def _packed(name: str, **columns: Column) -> Column:
    """The columns of a relation but its incident."""
    null = F.lit(None).cast("string")
    columns = {"kind": F.lit(name), "target_entry_id": null, "source_entry_id": null, **columns}
    return F.struct(*[columns[c].alias(c) for c in RELATION_COLUMNS[1:]])


def _metric_error(hit: str, t: ServiceThresholds) -> Column:
    lag = F.col(f"{hit}.us") - F.unix_micros("timestamp")
    evidence = F.array_compact(
        F.array(
            temporal_signal(lag, t.metric_to_error_us, t.temporal),
            same_service_signal(F.col("service_id"), F.col(f"{hit}.service_id"), t.same_service),
        )
    )
    reason = F.concat(
        F.lit("Metric anomaly '"), "title", F.lit("' temporally aligns with error '"), f"{hit}.title", F.lit("'")
    )
    return _packed(
        "metric_anomaly_to_error",
        source_id=F.col("id"),
        source_label=F.col("title"),
        target_id=F.col(f"{hit}.id"),
        target_label=F.col(f"{hit}.title"),
        evidence=evidence,
        reason=reason,
        source_entry_id=F.col("id"),
        target_entry_id=F.col(f"{hit}.id"),
    )


def _shared_metric_error(flags: SharedFlags, t: ServiceThresholds) -> DataFrame:
    """The next error of a scope is that of each window that reaches to it, unless one of the incident's own groups comes first."""
    placed = flags.entries.placed()
    error, metric = C.is_error(F.col("category"), F.col("severity")), F.col("category") == "metric"
    own = placed.beside().filter(error).withColumn("_own", F.struct(F.unix_micros("timestamp").alias("us"), "id", "title", "service_id"))
    rows = placed.events.filter(error | metric).select(
        "scope", "_at", "id", "timestamp", "title", "category", "severity", "service_id", "metric_name", "anomaly"
    )
    hit = {"_hit": Target(error, t.metric_to_error_us, strict=False)}
    found = next_targets(rows, ["scope"], hit, ["title", "service_id"]).filter(metric)
    found = cut(found.withColumn("_found", F.when(F.col("_hit").isNotNull(), _scored(_metric_error("_hit", t)))))
    each = flags.each(placed, found, F.col("anomaly"), placed.cuts(own.select("incident_id", "scope", "timestamp", "_own"), 2))
    near = F.col("_own.us") - F.unix_micros("timestamp") <= t.metric_to_error_us
    each = each.withColumns(
        {"_hit": F.when(F.col("_hit.us") <= F.unix_micros("window_end"), F.col("_hit")), "_own": F.when(near, F.col("_own"))}
    ).filter("_hit is not null or _own is not null")
    first = F.col("_own").isNotNull() & F.coalesce(F.col("_own") < F.col("_hit"), F.lit(True))
    return each.select("incident_id", F.when(first, _scored(_metric_error("_own", t))).otherwise(F.col("_found")).alias("r")).select(
        "incident_id", "r.*"
    ).unionByName(with_score(service_metric_error(placed.apart(), t)))


def service_metric_error(entries: DataFrame | SharedFlags, t: ServiceThresholds = ServiceThresholds()) -> DataFrame:
    """Flagged metric -> earliest error at or after it."""
    if isinstance(entries, SharedFlags):
        return _shared_metric_error(entries, t)
    error = C.is_error(F.col("category"), F.col("severity"))
    flagged = (F.col("category") == "metric") & F.col("anomaly")
    rows = entries.filter(error | flagged).select(
        "incident_id", "id", "timestamp", "title", "category", "severity", "service_id", "anomaly"
    )
    found = next_targets(
        rows, ["incident_id"], {"_hit": Target(error, t.metric_to_error_us, strict=False)}, ["title", "service_id"]
    ).filter(flagged & F.col("_hit").isNotNull())
    return found.select("incident_id", _metric_error("_hit", t).alias("r")).select("incident_id", "r.*")


def attribute_services(entries: DataFrame | SharedFlags, t: ServiceThresholds = ServiceThresholds()) -> DataFrame:
    """Flagged metrics and errors to the service that they name."""
    error, metric = C.is_error(F.col("category"), F.col("severity")), F.col("category") == "metric"
    named = F.col("service_name").isNotNull()
    wanted = (error | (metric & F.col("anomaly"))) & named
    word = F.when(error, "Error '").otherwise("Metric anomaly '")
    label = F.when(error, "Error group").otherwise("Metric anomaly")
    detail = F.concat(label, F.lit(" attributed to service '"), "service_name", F.lit("'"))
    weight = F.when(error, F.lit(0.5)).otherwise(F.lit(t.same_service))
    relation = _packed(
        "",
        kind=F.when(error, "error_to_service").otherwise("metric_anomaly_to_service"),
        source_id=F.col("id"),
        source_label=F.col("title"),
        target_id=F.concat(F.lit("service:"), "service_name"),
        target_label=F.col("service_name"),
        evidence=F.array(_signal("service_attribution", detail, weight)),
        reason=F.concat(word, "title", F.lit("' is attributed to service '"), "service_name", F.lit("'")),
        source_entry_id=F.col("id"),
    )
    if isinstance(entries, SharedFlags):  # an entry's relation is the same in all incidents
        placed = entries.entries.placed()
        rows = placed.events.filter((error | metric) & named).withColumn("r", _scored(relation))
        rows = rows.select("scope", "_at", "timestamp", "category", "severity", "title", "metric_name", "service_name", "anomaly", "r")
        each = entries.each(placed, rows, wanted).select("incident_id", "r.*")
        return each.unionByName(with_score(attribute_services(placed.groups, t)))
    return entries.filter(wanted).select("incident_id", relation.alias("r")).select("incident_id", "r.*")


def trace_errors(entries: DataFrame | SharedEntries, t: ServiceThresholds = ServiceThresholds()) -> DataFrame:
    """Entries and errors of one trace within the allowed distance.

    The join key holds a time bucket, so the work follows the number of
    results and a very large trace spreads over many tasks. Of shared entries
    both meet once per scope, and windows take those with both ends inside;
    ids of incidents in ``spans`` must be unique there.
    """
    if isinstance(entries, SharedEntries):
        placed = entries.placed()
        met = _trace_pairs(placed.events, "scope", t, F.col("_at")).select("scope", "_at", "_eat", _scored(F.col("r")).alias("r"))
        inside = placed.pairs(met, placed.spans).filter("_eat >= _from and _eat < _upto")
        return inside.select("incident_id", "r.*").unionByName(with_score(trace_errors(placed.groups, t)))
    return _trace_pairs(entries, "incident_id", t, F.lit(None)).select("incident_id", "r.*")


def _trace_pairs(entries: DataFrame, key: str, t: ServiceThresholds, place: Column) -> DataFrame:
    width = t.trace_to_error_us
    rows = entries.filter(F.coalesce(F.col("trace_id") != "", F.lit(False))).withColumn("_us", F.unix_micros("timestamp"))
    error = C.is_error(F.col("category"), F.col("severity"))
    left = rows.withColumn("_b", F.floor(F.col("_us") / width))
    near = F.floor(F.col("_us") / width)
    right = rows.filter(error).select(
        key,
        "trace_id",
        F.explode(F.sequence(near - 1, near + 1)).alias("_b"),
        F.col("id").alias("_eid"),
        F.col("title").alias("_etitle"),
        F.col("service_id").alias("_eservice"),
        F.col("_us").alias("_eus"),
        place.alias("_eat"),
    )
    joined = (
        left.join(right, [key, "trace_id", "_b"])
        .withColumn("_lag", F.abs(F.col("_eus") - F.col("_us")))
        .filter(F.col("_lag") <= width)
    )
    evidence = F.array_compact(
        F.array(
            _signal("shared_trace", F.concat(F.lit("Shared trace_id '"), "trace_id", F.lit("'")), F.lit(t.trace)),
            temporal_signal(F.col("_lag"), width, t.temporal),
            same_service_signal(F.col("service_id"), F.col("_eservice"), t.same_service),
        )
    )
    reason = F.concat(
        F.lit("Trace '"), "title", F.lit("' shares trace_id '"), "trace_id", F.lit("' with error '"), "_etitle", F.lit("'")
    )
    relation = _packed(
        "trace_to_error",
        source_id=F.col("id"),
        source_label=F.col("title"),
        target_id=F.col("_eid"),
        target_label=F.col("_etitle"),
        evidence=evidence,
        reason=reason,
        source_entry_id=F.col("id"),
        target_entry_id=F.col("_eid"),
    )
    return joined.withColumn("r", relation)


def service_chain(spans: DataFrame, keys: tuple[str, ...] = ("incident_id", "trace_id")) -> DataFrame:
    """Successive distinct services of a trace in first-seen order.

    The window runs over the services of a trace, not over its spans.
    """
    first = spans.groupBy(*keys, "service_name").agg(F.min(F.struct("timestamp", "id")).alias("_at"))
    w = Window.partitionBy(*keys).orderBy("_at")
    return (
        first.withColumn("target_service", F.lead("service_name").over(w))
        .filter(F.col("target_service").isNotNull())
        .select(*keys, F.col("service_name").alias("source_service"), "target_service")
    )


def _trace_spans(entries: DataFrame) -> DataFrame:
    return entries.filter(
        F.col("category").isin("trace", "log")
        & F.coalesce(F.col("trace_id") != "", F.lit(False))
        & F.col("service_name").isNotNull()
    ).select(
        "incident_id",
        "trace_id",
        "service_name",
        "timestamp",
        "id",
        F.nullif(F.trim("span_id"), F.lit("")).alias("span_id"),
        F.nullif(F.trim("parent_span_id"), F.lit("")).alias("parent_span_id"),
    )


def infer_dependencies(entries: DataFrame | SharedEntries) -> DataFrame:
    """Distinct (source depends on target) edges per incident, from traces.

    Of shared entries, the windows in which a trace shows an edge are found once
    per scope; ids of incidents in ``spans`` must be unique there.
    """
    if isinstance(entries, SharedEntries):
        own = infer_dependencies(entries.groups)
        spans = cut(_trace_spans(entries.events).withColumnRenamed("incident_id", "scope"))
        edges = cut(_order_edges(spans).unionByName(_parent_edges(spans)))
        w = entries.spans.select("incident_id", "scope", F.unix_micros("window_start").alias("start"), F.unix_micros("window_end").alias("end"))
        lasting = within_edges(edges.filter("until is null").drop("until"), w).unionByName(own)
        if edges.filter("until is not null").isEmpty():
            return lasting.distinct()
        # An edge that ends with a later parent holds for window ends in [from, until): the same search, with time reversed.
        ended = edges.filter("until is not null").select(
            "scope", "source_service", "target_service", (-F.col("until")).alias("after"), (-F.col("from")).alias("upto"), (-F.col("upto")).alias("from")
        )
        turned = w.select("incident_id", "scope", (-F.col("end")).alias("start"), (-F.col("start")).alias("end"))
        return lasting.unionByName(within_edges(ended, turned)).distinct()
    spans = _trace_spans(entries)
    parents = (
        spans.filter(F.col("span_id").isNotNull())
        .groupBy("incident_id", "trace_id", "span_id")
        .agg(F.max_by("service_name", F.struct("timestamp", "id")).alias("source_service"))
        .withColumnRenamed("span_id", "parent_span_id")
    )
    by_span = (
        spans.filter(F.col("parent_span_id").isNotNull())
        .join(parents, ["incident_id", "trace_id", "parent_span_id"])
        .filter(F.col("source_service") != F.col("service_name"))
        .select("incident_id", "source_service", F.col("service_name").alias("target_service"))
    )
    by_order = service_chain(spans).select("incident_id", "source_service", "target_service")
    return by_span.unionByName(by_order).distinct()


EDGE = "scope long, source_service string, target_service string, after long, upto long, from long"


def _chain_edges(batches):
    """Edges of slices of traces by where a window starts, from spans of a slice in turn, the latest first.

    Going back in time, a span's service moves to the front of the services in
    first-seen order, so three neighbours change at each step and no trace is held.
    First occurrences in later slices come before a slice's own spans.
    """
    import pyarrow as pa

    types = pa.schema([("scope", pa.int64()), ("source_service", pa.string()), ("target_service", pa.string())]
                      + [(c, pa.int64()) for c in ("after", "upto", "from")])
    key = before = None
    begun, order, first, since, out = False, [], {}, {}, []

    def end(pair, at):
        upto = since.pop(pair)
        if at is None or at < upto:
            out.append((key[0], *pair, at, upto, first[pair[1]]))

    def found():
        columns = list(zip(*out)) or [[]] * len(types)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    for batch in batches:
        names = ("scope", "trace_id", "_slice", "carried", "us", "service_name", "before")
        for scope, trace, part, carried, us, name, lower in zip(*[batch.column(c).to_pylist() for c in names]):
            if key != (scope, trace, part):
                for pair in list(since):
                    end(pair, before)
                key, before, begun, order, first = (scope, trace, part), lower, False, [], {}
            if carried:
                order.insert(0, name)
                first[name] = us
                continue
            if not begun:
                since.update({pair: us for pair in zip(order, order[1:])})
                begun = True
            if not order or order[0] != name:
                if name in first:
                    k = order.index(name)
                    end((order[k - 1], name), us)
                    if k + 1 < len(order):
                        end((name, order[k + 1]), us)
                        since[order[k - 1], order[k + 1]] = us
                    order.pop(k)
                if order:
                    since[name, order[0]] = us
                order.insert(0, name)
            first[name] = us
        yield found()
    for pair in list(since):
        end(pair, before)
    yield found()


def _order_edges(spans: DataFrame) -> DataFrame:
    """(scope, services, after, upto, from, until): where a window starts in (after, upto] and ends at ``from`` or later, its trace has the edge."""
    keys = ["scope", "trace_id"]
    sliced, _ = equal_slices(spans.select(*keys, "service_name", "timestamp", "id"), keys, "timestamp")
    rows = cut(sliced.withColumn("us", F.unix_micros("timestamp")).drop("timestamp"))
    firsts = rows.groupBy(*keys, "_slice", "service_name").agg(F.min(F.struct("us", "id")).alias("_at"))
    slices = rows.groupBy(*keys, "_slice").agg(F.max("us").alias("_last"))
    ordered = Window.partitionBy(*keys).orderBy("_slice")
    slices = slices.withColumn("before", F.lag("_last").over(ordered)).drop("_last")
    seen = slices.withColumnRenamed("_slice", "_s").join(firsts, keys).filter(F.col("_slice") > F.col("_s"))
    carried = seen.groupBy(*keys, "_s", "service_name").agg(F.min("_at").alias("_at"))
    carried = carried.select(*keys, F.col("_s").alias("_slice"), "service_name", "_at.us", "_at.id", F.lit(True).alias("carried"))
    both = rows.withColumn("carried", F.lit(False)).unionByName(carried).join(slices, [*keys, "_slice"])
    back = both.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", *[F.desc(c) for c in ("carried", "us", "id")])
    edges = back.mapInArrow(_chain_edges, EDGE)
    return edges.withColumn("until", F.lit(None).cast("bigint"))


def _parent_edges(spans: DataFrame) -> DataFrame:
    """Edges of spans and their parents; one that a later parent of the same span id but another service ends has ``until``."""
    keys = ["scope", "trace_id", "parent_span_id"]
    us = F.unix_micros("timestamp").alias("_p")
    parents = spans.filter("span_id is not null").groupBy("scope", "trace_id", F.col("span_id").alias("parent_span_id"), us)
    parents = parents.agg(F.max_by("service_name", F.struct("id")).alias("source_service"))
    w = Window.partitionBy(*keys).orderBy("_p")
    changed = F.when(F.lag("source_service").over(w) != F.col("source_service"), F.col("_p"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    parents = parents.withColumn("_c", changed).withColumn("until", F.min("_c").over(later))
    found = spans.filter("parent_span_id is not null").join(parents, keys).filter("source_service <> service_name")
    at = F.unix_micros("timestamp")
    return found.select(
        "scope", "source_service", F.col("service_name").alias("target_service"), F.lit(None).cast("bigint").alias("after"),
        F.least(at, "_p").alias("upto"), F.greatest(at, "_p").alias("from"), "until",
    ).filter("until is null or until > from")


STARTS = 4096  # distinct window starts of a scope that one task looks at


def _least_from(pdf):
    """The least ``from`` among the edges that hold at each rank of a window start."""
    import numpy as np
    import pandas as pd

    first = int(pdf["lo"].min())
    least = np.full(int(pdf["hi"].max()) - first + 1, np.iinfo(np.int64).max)
    for lo, hi, at in pdf.sort_values("from", ascending=False)[["lo", "hi", "from"]].itertuples(index=False):
        least[lo - first : hi - first + 1] = at
    kept = np.nonzero(least < np.iinfo(np.int64).max)[0]
    head = {c: pdf[c].iloc[0] for c in ("scope", "source_service", "target_service")}
    return pd.DataFrame({**head, "rank": kept + first, "from": least[kept]})


def within_edges(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (incident_id, source_service, target_service) where ``after`` < start <= ``upto`` and ``from`` <= end for some edge.

    Edges hold for ranks of the distinct starts of a scope; the least ``from`` of each
    rank decides, so edges and windows never meet in pairs.
    """
    starts = windows.select("scope", F.col("start").alias("_us")).distinct().withColumn("_n", F.lit(1).cast("bigint"))
    limits = edges.select("scope", F.col("upto").alias("_us")).union(edges.select("scope", "after").filter("after is not null")).distinct()
    line = cut(starts.withColumn("_side", F.lit(0)).unionByName(limits.withColumns({"_n": F.lit(0).cast("bigint"), "_side": F.lit(1)})))
    sliced, _ = equal_slices(line.withColumn("_ts", F.timestamp_micros("_us")), ["scope"], "_ts")
    ranked = cut(running_total(sliced, ["scope"], ["_slice"], ["_us", "_side"], F.col("_n"), "_rank").select("scope", "_us", "_side", "_rank"))
    most = ranked.agg(F.max("_rank")).first()[0] or 0
    size = max(STARTS, most // 16 + 1)
    upto = ranked.filter("_side = 1").select("scope", F.col("_us").alias("upto"), (F.col("_rank") - 1).alias("hi"))
    after = upto.select("scope", F.col("upto").alias("after"), (F.col("hi") + 1).alias("lo"))
    placed = edges.join(upto, ["scope", "upto"]).join(after, ["scope", "after"], "left").withColumn("lo", F.coalesce("lo", F.lit(0)))
    keys = ["scope", "source_service", "target_service"]
    held = placed.filter("lo <= hi").groupBy(*keys, "lo", "hi").agg(F.min("from").alias("from"))
    chunks = held.withColumn("_c", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    clipped = chunks.withColumns({"lo": F.greatest("lo", F.col("_c") * size), "hi": F.least("hi", (F.col("_c") + 1) * size - 1)})
    least = clipped.groupBy(*keys, "_c").applyInPandas(_least_from, "scope long, source_service string, target_service string, rank long, from long")
    ranks = ranked.filter("_side = 0").select("scope", F.col("_us").alias("start"), F.col("_rank").alias("rank"))
    asked = windows.join(ranks, ["scope", "start"])
    return asked.join(least, ["scope", "rank"]).filter(F.col("from") <= F.col("end")).select("incident_id", "source_service", "target_service")


def dependency_relations(deps: DataFrame, inferred_from: str = "trace") -> DataFrame:
    src, tgt = F.col("source_service"), F.col("target_service")
    text = F.concat(F.lit("Service '"), src, F.lit("' depends on '"), tgt, F.lit("'"))
    return _relation(
        deps,
        "service_dependency",
        source_id=F.concat(F.lit("service:"), src),
        source_label=src,
        target_id=F.concat(F.lit("service:"), tgt),
        target_label=tgt,
        evidence=F.array(_signal("dependency_edge", text, F.lit(0.5))),
        reason=F.concat(text, F.lit(f" (inferred from {inferred_from})")),
    )


def propagate_errors(entries: DataFrame, deps: DataFrame, t: ServiceThresholds = ServiceThresholds()) -> DataFrame:
    """Error of a service -> earliest error at or after it in a service that depends on it."""
    errors = entries.filter(C.is_error(F.col("category"), F.col("severity")) & F.col("service_name").isNotNull()).select(
        "incident_id", "id", "timestamp", "title", "service_name"
    )
    d = deps.select("incident_id", "source_service", "target_service")
    keys = ["incident_id", "source_service", "target_service"]
    up = errors.join(d, (errors.incident_id == d.incident_id) & (errors.service_name == d.target_service))
    down = errors.join(d, (errors.incident_id == d.incident_id) & (errors.service_name == d.source_service))
    cols = [errors.incident_id, "source_service", "target_service", "id", "timestamp", "title"]
    both = up.select(*cols, F.lit(False).alias("_tgt")).unionByName(down.select(*cols, F.lit(True).alias("_tgt")))
    found = next_targets(both, keys, {"_hit": Target(F.col("_tgt"), t.upstream_us, strict=False)}, ["title"])
    found = found.filter(~F.col("_tgt") & F.col("_hit").isNotNull())
    lag = F.col("_hit.us") - F.unix_micros("timestamp")
    src, tgt = F.col("source_service"), F.col("target_service")
    detail = F.concat(
        F.lit("Upstream service '"), tgt, F.lit("' error preceded downstream service '"), src, F.lit("' error")
    )
    evidence = F.array(
        temporal_signal(lag, t.upstream_us, t.temporal), _signal("dependency_edge", detail, F.lit(t.dependency))
    )
    return _relation(
        found,
        "upstream_error_propagation",
        source_id=F.col("id"),
        source_label=F.col("title"),
        target_id=F.col("_hit.id"),
        target_label=F.col("_hit.title"),
        evidence=evidence,
        reason=F.concat(
            F.lit("Upstream error on '"), tgt, F.lit("' preceded downstream error on '"), src, F.lit("'")
        ),
        source_entry_id=F.col("id"),
        target_entry_id=F.col("_hit.id"),
    )


def _score(evidence: Column) -> Column:
    return F.round(F.least(F.lit(1.0), C.total(F.transform(evidence, lambda e: e["weight"]))), 4)


def _scored(relation: Column) -> Column:
    return relation.withField("score", _score(relation["evidence"]))


def with_score(relations: DataFrame) -> DataFrame:
    """Relations with ``score``, which those of shared entries have already."""
    return relations if "score" in relations.columns else relations.withColumn("score", _score(F.col("evidence")))


def score_relationships(relations: DataFrame, min_score: float = ServiceThresholds().min_score) -> DataFrame:
    return with_score(relations).filter(F.col("score") >= min_score)


def service_relationships(
    entries: DataFrame, deps: DataFrame | None = None, t: ServiceThresholds = ServiceThresholds()
) -> DataFrame:
    """All scored relations; ``entries`` carry ``anomaly`` and ``service_name``."""
    deps = infer_dependencies(entries) if deps is None else deps
    parts = [
        service_metric_error(entries, t),
        attribute_services(entries, t),
        trace_errors(entries, t),
        dependency_relations(deps),
        propagate_errors(entries, deps, t),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return score_relationships(out, t.min_score)


def number_relationships(relations: DataFrame) -> DataFrame:
    """0-based ``index`` in the order score (highest first), kind, source, target."""
    sliced = relations.withColumns({"_neg": -F.col("score"), "_head": F.substring("source_id", 1, 10)})
    order = ["source_id", "target_id"]
    out = positions(sliced, ["incident_id"], ["_neg", "kind", "_head"], order, "index")
    return out.withColumn("index", F.col("index") - 1).drop("_neg", "_head")


def involved_services(entries: DataFrame | SharedEntries) -> DataFrame:
    """Sorted service names per incident; a name list is bounded by the service table."""
    rows = entries.counts("service_name") if isinstance(entries, SharedEntries) else entries
    return rows.filter(F.col("service_name").isNotNull()).groupBy("incident_id").agg(
        F.sort_array(F.collect_set("service_name")).alias("services")
    )
