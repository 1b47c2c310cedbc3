"""Timelines and evidence of many incidents in one job."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.config import AnomalyThresholds, CorrelationThresholds, DeploymentThresholds, ServiceThresholds
from faultline.operators import anomaly, correlate, deployments, evidence, services, timeline
from faultline.session import cut


@dataclass(frozen=True)
class Thresholds:
    anomaly: AnomalyThresholds = field(default_factory=AnomalyThresholds)
    correlation: CorrelationThresholds = field(default_factory=CorrelationThresholds)
    deployment: DeploymentThresholds = field(default_factory=DeploymentThresholds)
    service: ServiceThresholds = field(default_factory=ServiceThresholds)


@dataclass(frozen=True)
class Timelines:
    """Tables keyed by incident_id."""

    incidents: DataFrame
    services: DataFrame
    entries: DataFrame
    markers: DataFrame
    correlations: DataFrame
    assessments: DataFrame
    dependencies: DataFrame
    relationships: DataFrame
    counts: DataFrame

    def involved(self) -> DataFrame:
        return services.involved_services(self.entries)


@dataclass(frozen=True)
class Evidence:
    items: DataFrame
    relations: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chain: DataFrame
    quality: DataFrame
    summary: DataFrame


def timeline_entries(
    incidents: DataFrame, events: DataFrame, groups: DataFrame, service_names: DataFrame, now, t: Thresholds = Thresholds()
) -> DataFrame:
    """Annotated entries with service names; still one lazy plan."""
    lookback = t.deployment.lookback_us
    matched = timeline.incident_events(incidents, events, now, lookback)
    matched_groups = timeline.incident_groups(incidents, groups, now, lookback)
    entries = timeline.build_entries(matched, matched_groups)
    return services.with_service_names(anomaly.annotate_anomalies(entries, t.anomaly), service_names)


def shared_entries(
    incidents: DataFrame, events: DataFrame, groups: DataFrame, service_names: DataFrame, now, t: Thresholds = Thresholds()
) -> timeline.SharedEntries:
    """The entries of ``timeline_entries`` by scope, for steps that read no ``anomaly``.

    That flag is left out: it depends on where an incident's own series begins.
    As there, entries without a category are not listed.
    """
    shared = timeline.share_entries(incidents, events, groups, now, t.deployment.lookback_us)
    return replace(
        shared,
        events=services.with_service_names(shared.events.filter(F.col("category").isNotNull()), service_names),
        groups=services.with_service_names(shared.groups, service_names),
    )


def unique_entries(
    incidents: DataFrame, events: DataFrame, groups: DataFrame, now, t: Thresholds = Thresholds()
) -> timeline.SharedEntries:
    """Shared entries of incidents of an id of their own; those of other incidents are among ``groups``."""
    lookback = t.deployment.lookback_us
    ids = incidents.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    known = cut(incidents.join(ids, F.col("id").eqNullSafe(F.col("_id"))).withColumn("_one", F.expr("_n = 1 and id is not null")))
    alone, rest = (known.filter(c).drop("_id", "_n", "_one") for c in ("_one", "not _one"))
    shared = timeline.share_entries(alone, events, groups, now, lookback)
    own = timeline.build_entries(timeline.incident_events(rest, events, now, lookback), timeline.incident_groups(rest, groups, now, lookback))
    return replace(shared, groups=shared.groups.unionByName(own))


def unique_shared(
    incidents: DataFrame, events: DataFrame, groups: DataFrame, service_names: DataFrame, now, t: Thresholds = Thresholds()
) -> timeline.SharedEntries:
    """The entries of ``timeline_entries`` by scope for steps that read no ``anomaly``; ids of incidents in ``spans`` are unique."""
    shared = unique_entries(incidents, events, groups, now, t)
    listed = F.col("category").isNotNull()
    return replace(
        shared,
        events=services.with_service_names(shared.events.filter(listed), service_names),
        groups=services.with_service_names(shared.groups.filter(listed), service_names),
    )


def shared_dependencies(
    incidents: DataFrame, events: DataFrame, groups: DataFrame, service_names: DataFrame, now, t: Thresholds = Thresholds()
) -> DataFrame:
    """``infer_dependencies`` of the entries of ``timeline_entries``, by scope."""
    shared = unique_entries(incidents, events, groups, now, t)
    return services.infer_dependencies(
        replace(
            shared,
            events=services.with_service_names(shared.events, service_names),
            groups=services.with_service_names(shared.groups, service_names),
        )
    )


def shared_flags(
    incidents: DataFrame, events: DataFrame, groups: DataFrame, service_names: DataFrame, now, t: Thresholds = Thresholds()
) -> anomaly.SharedFlags:
    """The entries of ``timeline_entries`` by scope, with ``anomaly`` and where an incident's own series changes it.

    Incidents that share an id have one series from all their windows, so their entries stay their own.
    """
    flags = anomaly.annotate_shared(unique_entries(incidents, events, groups, now, t), t.anomaly)
    named = replace(
        flags.entries,
        events=services.with_service_names(flags.entries.events, service_names),
        groups=services.with_service_names(flags.entries.groups, service_names),
    )
    return replace(flags, entries=named)


def build_timelines(
    incidents: DataFrame,
    events: DataFrame,
    groups: DataFrame,
    service_names: DataFrame,
    now,
    t: Thresholds = Thresholds(),
) -> Timelines:
    """Entries are built once, written, and shared by every later step."""
    lookback = t.deployment.lookback_us
    matched = cut(timeline.incident_events(incidents, events, now, lookback))
    matched_groups = timeline.incident_groups(incidents, groups, now, lookback)
    raw = cut(timeline.build_entries(matched, matched_groups))
    annotated = anomaly.annotate_anomalies(raw, t.anomaly)
    entries = cut(evidence.number_entries(services.with_service_names(annotated, service_names)))
    marks = cut(timeline.markers(entries, incidents, lookback))
    links = cut(correlate.number_correlations(cut(correlate.correlate_temporal(entries, t.correlation))))
    deps = cut(services.infer_dependencies(entries))
    related = cut(services.service_relationships(entries, deps, t.service))
    return Timelines(
        incidents=incidents,
        services=service_names,
        entries=entries,
        markers=marks,
        correlations=links,
        assessments=cut(deployments.assess_deployment(marks, links, service_names, t.deployment)),
        dependencies=deps,
        relationships=cut(services.number_relationships(related)),
        counts=timeline.category_counts(entries),
    )


def build_evidence(tl: Timelines, built_at) -> Evidence:
    """Evidence items, relations, graph and quality of every incident."""
    ticks = cut(
        evidence.evidence_ticks(tl.markers, tl.correlations, tl.assessments, tl.relationships, tl.entries, built_at)
    )
    items = evidence.evidence_items(ticks)
    relations = evidence.evidence_relations(ticks, tl.correlations)
    nodes = cut(
        evidence.graph_nodes(tl.markers, tl.entries, tl.correlations, tl.assessments, tl.relationships, tl.services)
    )
    edges = cut(evidence.graph_edges(nodes, tl.correlations, tl.relationships))
    return Evidence(
        items=items,
        relations=relations,
        nodes=nodes,
        edges=edges,
        chain=evidence.graph_chain(nodes),
        quality=evidence.evidence_quality(items, relations, nodes, edges),
        summary=evidence.evidence_summary(tl.entries, tl.correlations, tl.assessments, tl.relationships),
    )


def evidence_package(tl: Timelines, ev: Evidence) -> DataFrame:
    """One row per incident: summary, chain, quality and counts."""
    quality = ev.quality.withColumnRenamed("summary", "quality_summary")
    chain = ev.chain.withColumnRenamed("summary", "graph_summary")
    return ev.summary.join(chain, "incident_id", "left").join(quality, "incident_id", "left").select(
        "incident_id",
        "summary",
        "chain",
        "graph_summary",
        F.col("score").alias("quality_score"),
        "level",
        "weakest",
        "quality_summary",
        "evidence_count",
        "relation_count",
        "node_count",
        "edge_count",
    )
