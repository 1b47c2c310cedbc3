"""Timeline, correlation, service, deployment and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import roles_sql as Q
from catalog.roles import NOW
from faultline.functions import scores as C
from faultline.functions.text import format_duration
from faultline.operators import anomaly, asof, correlate, deployments, evidence, services, timeline
from faultline.plans import documents as D
from faultline.plans import packages as P
from faultline.plans import timelines as TL
from faultline.session import shared_path

US = "unix_micros(timestamp) as us"


def entries(t):
    return TL.timeline_entries(t.incidents, t.events, t.groups, t.services, NOW)


def shared(t):
    return TL.shared_entries(t.incidents, t.events, t.groups, t.services, NOW)


def flags(t):
    return TL.shared_flags(t.incidents, t.events, t.groups, t.services, NOW)


def tl_sql(*more: str) -> str:
    return Q.cte(*Q.TIMELINE, *more)


@query(
    "j3_incident_events",
    Q.cte(Q.EV, Q.INC, Q.WIN, Q.ME) + " SELECT incident_id, id AS event_id, us FROM me",
)
def j3(t):
    m = timeline.incident_events(t.incidents, t.events, NOW)
    return m.selectExpr("incident_id", "id as event_id", US)


@query(
    "j4_incident_groups",
    Q.cte(Q.EV, Q.GRP, Q.INC, Q.WIN, Q.MG) + " SELECT incident_id, id AS group_id, first_us, last_us FROM mg",
)
def j4(t):
    m = timeline.incident_groups(t.incidents, t.groups, NOW)
    return m.selectExpr("incident_id", "id as group_id", "unix_micros(first_seen) as first_us", "unix_micros(last_seen) as last_us")


@query(
    "j5_x23_x24_u1_u3_entries",
    Q.cte(Q.EV, Q.GRP, Q.INC, Q.WIN, Q.ME, Q.MG, Q.EN)
    + " SELECT incident_id, id, category, us, title, summary, severity, event_id, error_group_id, service_id, occurrence_count FROM en",
)
def j5(t):
    e = timeline.build_entries(
        timeline.incident_events(t.incidents, t.events, NOW), timeline.incident_groups(t.incidents, t.groups, NOW)
    )
    return e.selectExpr(
        "incident_id", "id", "category", US, "title", "summary", "severity", "event_id", "error_group_id", "service_id", "occurrence_count"
    )


@query(
    "k3_timeline_order",
    Q.cte(Q.EV, Q.GRP, Q.INC, Q.WIN, Q.ME, Q.MG, Q.EN)
    + " SELECT incident_id, id, row_number() OVER (PARTITION BY incident_id ORDER BY us, id) - 1 AS entry_index FROM en",
)
def k3(t):
    e = TL.unique_entries(t.incidents, t.events, t.groups, NOW)
    return evidence.number_entries(e).select("incident_id", "id", "entry_index")


@query(
    "w7_annotate_anomalies",
    tl_sql() + " SELECT incident_id, id, us, anomaly FROM an WHERE category = 'metric'",
)
def w7(t):
    return flags(t).flagged().selectExpr("incident_id", "id", US, "anomaly")


@query(
    "x25_entry_predicates",
    tl_sql()
    + f""" SELECT category, count(*) FILTER (WHERE {Q.IS_ANOMALY}) AS n_anomaly, count(*) FILTER (WHERE {Q.IS_ERROR}) AS n_error,
    count(*) FILTER (WHERE category = 'metric' AND anomaly) AS n_flagged,
    count(*) FILTER (WHERE category = 'alert' AND coalesce(upper(status) = 'RESOLVED', false)) AS n_resolved FROM an GROUP BY 1""",
)
def x25(t):
    return anomaly.predicate_counts(TL.shared_flags(t.incidents, t.events, t.groups, t.services, NOW))


@query("a7_category_counts", tl_sql() + " SELECT incident_id, category, count(*) AS n FROM an GROUP BY 1, 2")
def a7(t):
    return timeline.category_counts(shared(t))


@query(
    "w8_markers",
    tl_sql(Q.MARK)
    + """ SELECT incident_id, fa.id AS anomaly_id, er.id AS error_id, er.title AS error_title, fal.id AS alert_id, dep.id AS deployment_id,
    dep.us AS deployment_us, rec_id, rec_us FROM mk""",
)
def w8(t):
    return timeline.markers(shared(t), t.incidents).selectExpr(
        "incident_id",
        "first_anomaly.id as anomaly_id",
        "first_relevant_error.id as error_id",
        "first_relevant_error.title as error_title",
        "first_alert.id as alert_id",
        "recent_deployment.id as deployment_id",
        "unix_micros(recent_deployment.timestamp) as deployment_us",
        "recovery.id as rec_id",
        "unix_micros(recovery.timestamp) as rec_us",
    )


@query(
    "j6_asof_forward",
    Q.cte(Q.EV)
    + """, d AS (SELECT * FROM ev WHERE event_type = 'DEPLOYMENT'), l AS (SELECT * FROM ev WHERE event_type = 'LOG')
    SELECT d.project_id, d.id AS source_id, arg_min(l.id, (l.us, l.id)) AS target_id, min(l.us) - d.us AS lag_us,
      round(1.0 - (min(l.us) - d.us)::DOUBLE / 7200000000, 6) AS score
    FROM d JOIN l ON d.project_id = l.project_id AND l.us > d.us AND l.us <= d.us + 7200000000
    GROUP BY d.project_id, d.id, d.us HAVING 1.0 - (min(l.us) - d.us)::DOUBLE / 7200000000 >= 0.1""",
)
def j6(t):
    d, log = t.events.filter("event_type = 'DEPLOYMENT'"), t.events.filter("event_type = 'LOG'")
    out = asof.asof_forward(d, log, ["project_id"], 7_200_000_000)
    return out.select("project_id", "source_id", "target_id", "lag_us", "score")


@query(
    "j6_asof_forward_or_equal",
    Q.cte(Q.EV)
    + """, l AS (SELECT * FROM ev WHERE event_type = 'LOG')
    SELECT d.project_id, d.id AS source_id, arg_min(l.id, (l.us, l.id)) AS target_id, min(l.us) - d.us AS lag_us,
      round(1.0 - (min(l.us) - d.us)::DOUBLE / 1800000000, 6) AS score
    FROM l d JOIN l ON d.project_id = l.project_id AND l.us >= d.us AND l.us <= d.us + 1800000000 AND l.id <> d.id
    GROUP BY d.project_id, d.id, d.us HAVING 1.0 - (min(l.us) - d.us)::DOUBLE / 1800000000 >= 0.1""",
)
def j6b(t):
    log = t.events.filter("event_type = 'LOG'")
    out = asof.asof_forward(log, log, ["project_id"], 1_800_000_000, strict=False)
    return out.select("project_id", "source_id", "target_id", "lag_us", "score")


@query(
    "j7_correlate_temporal",
    tl_sql(Q.CORR) + " SELECT incident_id, kind, source_id, target_id, lag_us, score, reason FROM corr",
)
def j7(t):
    return correlate.correlate_temporal(flags(t)).select(
        "incident_id", "kind", "source_id", "target_id", "lag_us", "score", "reason"
    )


@query(
    "x26_x27_lag_score_and_duration",
    Q.cte(Q.EV)
    + f""", p AS (SELECT id, us - lag(us) OVER (PARTITION BY project_id ORDER BY us, id) AS d FROM ev)
    SELECT id, CASE WHEN d >= 0 AND d <= 1800000000 THEN round(1.0 - d::DOUBLE / 1800000000, 6) ELSE 0.0 END AS score,
      {Q.duration('d')} AS words FROM p WHERE d IS NOT NULL""",
)
def x26(t):
    from pyspark.sql import Window

    w = Window.partitionBy("project_id").orderBy("us", "id")
    d = t.events.selectExpr("id", "project_id", US).withColumn("d", F.col("us") - F.lag("us").over(w)).filter("d is not null")
    return d.select("id", F.round(C.lag_score(F.col("d"), 1_800_000_000), 6).alias("score"), format_duration(F.col("d")).alias("words"))


def _temporal(lag: str, limit: int) -> str:
    return f"round(0.4 * (1.0 - ({lag})::DOUBLE / {limit}), 4)"


J8 = Q._asof("m8", "@category = 'metric' AND @anomaly", Q._ERR, 1800000000, strict=False)
R8 = f"""r8 AS (SELECT m.incident_id, 'metric_anomaly_to_error' AS kind, s.id AS source_id, s.title AS source_label, m.tgt.id AS target_id,
  m.tgt.title AS target_label, {_temporal('m.tgt.us - s.us', 1800000000)} + CASE WHEN s.service_id = m.tgt.service_id THEN 0.3 ELSE 0.0 END AS w
  FROM m8 m JOIN an s ON s.incident_id = m.incident_id AND s.id = m.sid)"""
R13 = f"""r13 AS (SELECT incident_id, CASE WHEN {Q.IS_ERROR} THEN 'error_to_service' ELSE 'metric_anomaly_to_service' END AS kind, id AS source_id,
  title AS source_label, 'service:' || service_name AS target_id, service_name AS target_label, CASE WHEN {Q.IS_ERROR} THEN 0.5 ELSE 0.3 END AS w
  FROM an WHERE service_name IS NOT NULL AND ({Q.IS_ERROR} OR (category = 'metric' AND anomaly)))"""
R9 = f"""r9 AS (SELECT s.incident_id, 'trace_to_error' AS kind, s.id AS source_id, s.title AS source_label, t.id AS target_id, t.title AS target_label,
  0.3 + {_temporal('abs(t.us - s.us)', 300000000)} + CASE WHEN s.service_id = t.service_id THEN 0.3 ELSE 0.0 END AS w
  FROM an s JOIN an t ON s.incident_id = t.incident_id AND s.trace_id = t.trace_id AND abs(t.us - s.us) <= 300000000
  WHERE {Q._ERR.replace('@', 't.')})"""
DEPS = """spans AS (SELECT * FROM an WHERE category IN ('trace', 'log') AND trace_id IS NOT NULL AND service_name IS NOT NULL),
par AS (SELECT incident_id, trace_id, span_id, arg_max(service_name, (us, id)) AS ps FROM spans WHERE span_id IS NOT NULL GROUP BY ALL),
firsts AS (SELECT incident_id, trace_id, service_name, min((us, id)) AS f_at FROM spans GROUP BY ALL),
leads AS (SELECT incident_id, service_name AS a, lead(service_name) OVER (PARTITION BY incident_id, trace_id ORDER BY f_at) AS b FROM firsts),
deps AS (
  SELECT DISTINCT s.incident_id, p.ps AS source_service, s.service_name AS target_service FROM spans s
    JOIN par p ON p.incident_id = s.incident_id AND p.trace_id = s.trace_id AND p.span_id = s.parent_span_id WHERE p.ps <> s.service_name
  UNION SELECT incident_id, a, b FROM leads WHERE b IS NOT NULL)"""
R10 = """r10 AS (SELECT incident_id, 'service_dependency' AS kind, 'service:' || source_service AS source_id, source_service AS source_label,
  'service:' || target_service AS target_id, target_service AS target_label, 0.5 AS w FROM deps)"""
R11 = f"""p11 AS (
  SELECT d.incident_id, d.source_service, d.target_service, u.id AS sid, u.title AS stitle, u.us AS sus, arg_min(e, (e.us, e.id)) AS tgt
  FROM deps d JOIN an u ON u.incident_id = d.incident_id AND u.service_name = d.target_service AND {Q._ERR.replace('@', 'u.')}
    JOIN an e ON e.incident_id = d.incident_id AND e.service_name = d.source_service AND {Q._ERR.replace('@', 'e.')}
      AND e.us >= u.us AND e.us <= u.us + 900000000 GROUP BY ALL),
r11 AS (SELECT incident_id, 'upstream_error_propagation' AS kind, sid AS source_id, stitle AS source_label, tgt.id AS target_id,
  tgt.title AS target_label, {_temporal('tgt.us - sus', 900000000)} + 0.3 AS w FROM p11)"""
REL = """rel AS (
  SELECT incident_id, kind, source_id, source_label, target_id, target_label, round(least(1.0, w::DOUBLE), 4) AS score FROM (
    SELECT * FROM r8 UNION ALL SELECT * FROM r13 UNION ALL SELECT * FROM r9 UNION ALL SELECT * FROM r10 UNION ALL SELECT * FROM r11)
  WHERE round(least(1.0, w), 4) >= 0.2)"""
ALL_REL = (J8, R8, R13, R9, DEPS, R10, R11, REL)
REL_OUT = "SELECT incident_id, kind, source_id, target_id, round(least(1.0, w), 4)::DOUBLE AS score FROM"


def scored(rel):
    return services.score_relationships(rel, 0.0).select("incident_id", "kind", "source_id", "target_id", "score")


@query("j8_service_metric_error", tl_sql(J8, R8) + f" {REL_OUT} r8")
def j8(t):
    return scored(services.service_metric_error(flags(t)))


@query("j13_attribute_services", tl_sql(R13) + f" {REL_OUT} r13")
def j13(t):
    return scored(services.attribute_services(flags(t)))


@query("j9_trace_errors", tl_sql(R9) + f" {REL_OUT} r9")
def j9(t):
    return scored(services.trace_errors(TL.unique_shared(t.incidents, t.events, t.groups, t.services, NOW)))


@query("j10_w9_u2_infer_dependencies", tl_sql(DEPS) + " SELECT * FROM deps")
def j10(t):
    return TL.shared_dependencies(t.incidents, t.events, t.groups, t.services, NOW)


@query(
    "w9_conversation_role_chain",
    """WITH f AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2),
    l AS (SELECT conv_id, role AS source_service, lead(role) OVER (PARTITION BY conv_id ORDER BY first) AS target_service FROM f)
    SELECT * FROM l WHERE target_service IS NOT NULL""",
)
def w9(t):
    spans = t.table("conversations").selectExpr("conv_id", "role as service_name", "turn as timestamp", "turn as id")
    return services.service_chain(spans, ("conv_id",))


@query("j11_propagate_errors", tl_sql(DEPS, R11) + f" {REL_OUT} r11")
def j11(t):
    from faultline.session import cut

    e = cut(entries(t))
    return scored(services.propagate_errors(e, services.infer_dependencies(e)))


@query(
    "a9_score_relationships",
    tl_sql(*ALL_REL)
    + """ SELECT incident_id, kind, source_id, target_id, score,
      row_number() OVER (PARTITION BY incident_id ORDER BY -score, kind, source_id, target_id) - 1 AS index FROM rel""",
)
def a9(t):
    from faultline.session import cut

    rel = cut(services.service_relationships(cut(entries(t))))
    return services.number_relationships(rel).select("incident_id", "kind", "source_id", "target_id", "score", "index")


@query(
    "a9_involved_services",
    tl_sql()
    + " SELECT incident_id, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM an WHERE service_name IS NOT NULL GROUP BY 1",
)
def a9b(t):
    return services.involved_services(shared(t)).select("incident_id", F.array_join("services", ",").alias("services"))


LOW = "lower(dep.repository)"
A8 = f"""link AS (SELECT incident_id, source_id, score FROM corr WHERE kind = 'deployment_to_error'),
a0 AS (
  SELECT mk.*, svc.name AS affected, link.score AS ls, er.us - dep.us AS el, fa.us - dep.us AS al,
    coalesce(len(list_filter(dep.changed_files, lambda f: contains(lower(er.title || ' ' || er.summary), lower(list_last(string_split(f, '/'))))
      OR contains(lower(er.title || ' ' || er.summary), lower(f)))), 0) AS ov
  FROM mk LEFT JOIN svc ON svc.id = mk.incident_service_id
    LEFT JOIN link ON link.incident_id = mk.incident_id AND link.source_id = mk.dep.id),
a1 AS (
  SELECT *, dep IS NOT NULL AS here, er IS NOT NULL AS has_er,
    coalesce(contains({LOW}, affected) OR contains(lower(dep.title), affected), false) AS named FROM a0),
a2 AS (
  SELECT *, here AND el > 0 AND el <= 7200000000 AS s2, here AND al > 0 AND al <= 7200000000 AS s3, here AND ls IS NOT NULL AS s4,
    here AND named AS s5, here AND has_er AND ov > 0 AS s6, here AND el <= 0 AS f1, here AND al <= 0 AS f2,
    here AND affected IS NOT NULL AND NOT named AS x1, here AND has_er AND ls IS NULL AS x2 FROM a1),
a3 AS (
  SELECT *, coalesce(s2, false) OR coalesce(s3, false) OR s4 OR s6 AS strong, coalesce(f1, false) OR coalesce(f2, false) AS fatal,
    CASE WHEN here THEN 0.15e0 ELSE 0 END + CASE WHEN s2 THEN 0.35e0 ELSE 0 END + CASE WHEN s3 THEN 0.25e0 ELSE 0 END
      + CASE WHEN s4 THEN round(0.2e0 + 0.2e0 * ls, 4) ELSE 0 END + CASE WHEN s5 THEN 0.2e0 ELSE 0 END + CASE WHEN s6 THEN 0.25e0 ELSE 0 END AS sup FROM a2),
a4 AS (
  SELECT *, CASE WHEN NOT here THEN 0.5e0 ELSE 0 END + CASE WHEN f1 THEN 0.5e0 ELSE 0 END + CASE WHEN f2 THEN 0.4e0 ELSE 0 END
    + CASE WHEN x1 THEN 0.2e0 ELSE 0 END + CASE WHEN x2 THEN 0.2e0 ELSE 0 END + CASE WHEN here AND NOT strong THEN 0.3e0 ELSE 0 END AS con FROM a3),
ass AS (
  SELECT *, CAST(CAST(greatest(0e0, least(1e0, 0.5e0 + (sup::DOUBLE - con::DOUBLE) * 0.25e0)) AS VARCHAR) AS DECIMAL(18, 4))::DOUBLE AS rscore FROM a4)"""


@query(
    "a8_j15_assess_deployment",
    tl_sql(Q.MARK, Q.CORR, A8)
    + """ SELECT incident_id, dep.id AS deployment_id, rscore AS score, here AND strong AND NOT fatal AND rscore >= 0.4 AS is_related,
    round(sup::DOUBLE, 6) AS supporting, round(con::DOUBLE, 6) AS contradicting FROM ass""",
)
def a8(t):
    from faultline.session import cut

    e = shared(t)
    marks = cut(timeline.markers(e, t.incidents))
    a = deployments.assess_deployment(marks, correlate.deployment_links(e, marks), t.services)
    return a.select(
        "incident_id",
        F.col("recent_deployment.id").alias("deployment_id"),
        F.col("relationship_score").alias("score"),
        "is_related",
        F.round(C.total(F.transform("supporting", lambda s: s["weight"])), 6).alias("supporting"),
        F.round(C.total(F.transform("contradicting", lambda s: s["weight"])), 6).alias("contradicting"),
    )


def built(t):
    tl = TL.build_timelines(t.incidents, t.events, t.groups, t.services, NOW)
    return tl, TL.build_evidence(tl, NOW)


CHAIN_SQL = f"""idx AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY source_us, target_us, score DESC, kind, source_id) - 1 AS index FROM corr),
flag AS (SELECT incident_id, arg_min(an, (us, id)) AS fl FROM an WHERE category = 'metric' AND anomaly GROUP BY 1),
intoe AS (SELECT incident_id, target_id, max(score) AS s FROM corr GROUP BY 1, 2),
rsc AS (SELECT incident_id, target_label, max(score) AS s FROM rel GROUP BY 1, 2),
n0 AS (
  SELECT ass.*, CASE WHEN fl IS NOT NULL THEN fl WHEN fa.category = 'metric' THEN fa END AS met, intoe.s AS into_s,
    coalesce(es.name, affected) AS sname, rsc.s AS srv_s
  FROM ass LEFT JOIN flag USING (incident_id)
    LEFT JOIN intoe ON intoe.incident_id = ass.incident_id AND intoe.target_id = ass.er.id
    LEFT JOIN svc es ON es.id = ass.er.service_id
    LEFT JOIN rsc ON rsc.incident_id = ass.incident_id AND rsc.target_label = coalesce(es.name, affected)),
nodes AS (
  SELECT incident_id, 0 AS position, 'node:deployment' AS node_id, dep.us AS us, dep.id AS entry, greatest(0.6, rscore) AS confidence FROM n0 WHERE dep IS NOT NULL
  UNION ALL SELECT incident_id, 1, 'node:metric-anomaly', met.us, met.id, 0.8 FROM n0 WHERE met IS NOT NULL
  UNION ALL SELECT incident_id, 2, 'node:error-increase', er.us, er.id, greatest(0.85, coalesce(into_s, 0)) FROM n0 WHERE er IS NOT NULL
  UNION ALL SELECT incident_id, 3, 'node:service-failure', coalesce(er.us, started_us), NULL, greatest(0.7, coalesce(srv_s, 0)) FROM n0 WHERE sname IS NOT NULL
  UNION ALL SELECT incident_id, 4, 'node:incident', started_us, NULL, 1.0 FROM n0)"""

EDGE_SQL = """nx AS (
  SELECT *, lead(node_id) OVER w AS to_id, lead(us) OVER w AS to_us FROM nodes WINDOW w AS (PARTITION BY incident_id ORDER BY position)),
ct AS (SELECT incident_id, source_us, target_us, arg_min(score, index) AS score FROM idx GROUP BY ALL),
ch AS (
  SELECT nx.incident_id, 0 AS o, position AS rk, node_id AS source_id, to_id AS target_id, 'leads_to' AS kind,
    CASE WHEN ct.score IS NOT NULL THEN round(ct.score, 4) WHEN to_us < us THEN 0.2
      ELSE round(greatest(0.3, least(0.95, 0.95 - (to_us - us)::DOUBLE / 3600000000 * 0.1)), 4) END AS confidence
  FROM nx LEFT JOIN ct ON ct.incident_id = nx.incident_id AND ct.source_us = nx.us AND ct.target_us = nx.to_us WHERE to_id IS NOT NULL),
ridx AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY -score, kind, source_id, target_id) - 1 AS index FROM rel),
lk AS (
  SELECT incident_id, 1 AS o, index AS rk, source_id AS se, target_id AS te,
    CASE WHEN kind = 'deployment_to_error' THEN 'escalated_to' ELSE 'correlates_with' END AS kind, score FROM idx
  UNION ALL SELECT incident_id, 2, index, source_id, target_id, 'correlates_with', score FROM ridx
    WHERE kind IN ('metric_anomaly_to_error', 'trace_to_error', 'upstream_error_propagation')),
lk2 AS (
  SELECT lk.incident_id, o, rk, a.node_id AS source_id, b.node_id AS target_id, lk.kind, lk.score AS confidence FROM lk
    JOIN nodes a ON a.incident_id = lk.incident_id AND a.entry = lk.se JOIN nodes b ON b.incident_id = lk.incident_id AND b.entry = lk.te),
edges AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, source_id, target_id ORDER BY o, rk) AS r
    FROM (SELECT * FROM ch UNION ALL SELECT * FROM lk2)) WHERE r = 1)"""
GRAPH = (Q.MARK, Q.CORR, A8, *ALL_REL, CHAIN_SQL)


@query("p3_graph_nodes", tl_sql(*GRAPH) + " SELECT incident_id, node_id, us, entry, round(confidence::DOUBLE, 6) AS confidence FROM nodes")
def p3(t):
    _, ev = built(t)
    return ev.nodes.selectExpr(
        "incident_id", "node_id", US, "timeline_entry_id as entry", "round(confidence, 6) as confidence"
    )


@query(
    "p4_j17_graph_edges",
    tl_sql(*GRAPH, EDGE_SQL)
    + " SELECT incident_id, source_id, target_id, kind, round(confidence::DOUBLE, 6) AS confidence FROM edges",
)
def p4(t):
    _, ev = built(t)
    return ev.edges.selectExpr("incident_id", "source_id", "target_id", "kind", "round(confidence, 6) as confidence")


SIGNALS = "(here::INT + coalesce(s2, false)::INT + coalesce(s3, false)::INT + s4::INT + s5::INT + coalesce(s6, false)::INT)"
CONTRA = "((NOT here)::INT + coalesce(f1, false)::INT + coalesce(f2, false)::INT + coalesce(x1, false)::INT + coalesce(x2, false)::INT + (here AND NOT strong)::INT)"
RSIG = "CASE kind WHEN 'metric_anomaly_to_error' THEN 1 + same WHEN 'trace_to_error' THEN 2 + same WHEN 'upstream_error_propagation' THEN 2 ELSE 1 END"
COUNT_SQL = f"""sg AS (SELECT incident_id, {SIGNALS} AS ns, {CONTRA} AS nc FROM ass),
mkn AS (SELECT incident_id, (fa IS NOT NULL)::INT + (er IS NOT NULL)::INT + (fal IS NOT NULL)::INT + (dep IS NOT NULL)::INT + (rec_id IS NOT NULL)::INT AS nm FROM mk),
cn AS (SELECT incident_id, count(*) AS nt FROM corr GROUP BY 1),
srv AS (SELECT r.incident_id, r.kind, coalesce(a.service_id = b.service_id, false)::INT AS same FROM rel r
  LEFT JOIN an a ON a.incident_id = r.incident_id AND a.id = r.source_id LEFT JOIN an b ON b.incident_id = r.incident_id AND b.id = r.target_id),
rn AS (SELECT incident_id, count(*) AS nr, sum({RSIG}) AS nsig FROM srv GROUP BY 1),
fn AS (SELECT incident_id, count(*) AS nf FROM an WHERE category = 'metric' AND anomaly GROUP BY 1),
cnt AS (SELECT i.id AS incident_id, coalesce(nm, 0) AS nm, coalesce(nt, 0) AS nt, ns, nc, coalesce(nr, 0) AS nr, coalesce(nsig, 0) AS nsig, coalesce(nf, 0) AS nf
  FROM inc i LEFT JOIN mkn ON mkn.incident_id = i.id LEFT JOIN cn ON cn.incident_id = i.id LEFT JOIN sg ON sg.incident_id = i.id
  LEFT JOIN rn ON rn.incident_id = i.id LEFT JOIN fn ON fn.incident_id = i.id)"""
EVID = (Q.MARK, Q.CORR, A8, *ALL_REL, COUNT_SQL)


@query(
    "p1_evidence_items",
    tl_sql(*EVID)
    + """ SELECT incident_id, CAST(nm + 2 * nt + ns + nc + 2 * nr + nsig + nf AS BIGINT) AS items,
      CAST(nm + 2 * nt + ns + nc + ns * nc + 2 * nr + nsig + nf AS BIGINT) AS counter, CAST(nm AS BIGINT) AS neutral, CAST(nc AS BIGINT) AS contradicting
      FROM cnt WHERE nm + nt + ns + nc + nr + nf > 0""",
)
def p1(t):
    tl, ev = built(t)
    return ev.items.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("items"),
        # The counter also numbers deployment relations, which stand between items.
        F.max("n").alias("last_item"),
        F.count_if(F.col("stance") == "neutral").alias("neutral"),
        F.count_if(F.col("stance") == "contradicting").alias("contradicting"),
    ).join(
        ev.relations.filter("key like 'deployment-rel-%'")
        .groupBy("incident_id")
        .agg(F.max(F.regexp_extract("key", r"(\d+)$", 1).cast("bigint")).alias("last_rel")),
        "incident_id",
        "left",
    ).select("incident_id", "items", F.greatest("last_item", "last_rel").alias("counter"), "neutral", "contradicting")


@query(
    "p2_evidence_relations",
    tl_sql(*EVID, "ck AS (SELECT incident_id, count(*) AS caused FROM corr WHERE kind = 'deployment_to_error' GROUP BY 1)")
    + """ SELECT incident_id, CAST(nt + ns * nc + nr AS BIGINT) AS relations, CAST(ns * nc AS BIGINT) AS contradicts,
      CAST(coalesce(caused, 0) AS BIGINT) AS caused_by FROM cnt LEFT JOIN ck USING (incident_id) WHERE nt + ns * nc + nr > 0""",
)
def p2(t):
    _, ev = built(t)
    return ev.relations.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("relations"),
        F.count_if(F.col("kind") == "contradicts").alias("contradicts"),
        F.count_if(F.col("kind") == "caused_by").alias("caused_by"),
    )


QUAL = f"""tc AS (SELECT incident_id, score FROM corr UNION ALL SELECT incident_id, score FROM rel
  UNION ALL SELECT incident_id, 0.5 FROM sg, range(64) x(i) WHERE x.i < ns * nc),
lk3 AS (SELECT incident_id, score AS c FROM tc UNION ALL SELECT incident_id, confidence FROM edges),
st AS (SELECT incident_id, avg(c::DOUBLE) * 100.0 AS strength FROM lk3 GROUP BY 1),
nd AS (SELECT incident_id, count(*) AS nn, sum(CASE WHEN to_us IS NULL THEN 0 WHEN us <= to_us THEN 1 ELSE 0 END) AS okp FROM nx GROUP BY 1),
q0 AS (
  SELECT cnt.incident_id, round(((nm > 0)::INT + (nt > 0)::INT + (ns + nc > 0)::INT + (nr > 0)::INT + (nf > 0)::INT) / 5.0 * 100.0, 2) AS source_diversity,
    round(CASE WHEN nn >= 2 THEN okp / (nn - 1)::DOUBLE * 100.0 ELSE 50.0 END, 2) AS temporal_consistency,
    round(coalesce(strength, 50.0), 2) AS correlation_strength,
    round(0.6 * least(100.0, nn / 5.0 * 100.0) + 0.2 * least(100.0, (nt + ns * nc + nr) * 20.0) + 0.2 * least(100.0, (nm + 2 * nt + ns + nc + 2 * nr + nsig + nf) * 5.0), 2) AS completeness,
    round(greatest(0.0, (2 * nt + ns + 2 * nr + nsig + nf)::DOUBLE / (2 * nt + ns + 2 * nr + nsig + nf + nc) * 100.0 - least(50.0, ns * nc * 15.0)), 2) AS consistency
  FROM cnt LEFT JOIN st USING (incident_id) LEFT JOIN nd USING (incident_id))"""


@query(
    "a10_evidence_quality",
    tl_sql(Q.MARK, Q.CORR, A8, *ALL_REL, CHAIN_SQL, EDGE_SQL, COUNT_SQL, QUAL)
    + """ SELECT incident_id, source_diversity::DOUBLE AS source_diversity, temporal_consistency::DOUBLE AS temporal_consistency,
      completeness::DOUBLE AS completeness, consistency::DOUBLE AS consistency, round(correlation_strength, 1) AS correlation_strength FROM q0""",
)
def a10(t):
    _, ev = built(t)
    return ev.quality.select(
        "incident_id",
        "source_diversity",
        "temporal_consistency",
        "completeness",
        "consistency",
        F.round("correlation_strength", 1).alias("correlation_strength"),
    )


@query(
    "p5_p6_evidence_package",
    tl_sql(Q.MARK, Q.CORR, A8, *ALL_REL, CHAIN_SQL)
    + """, e AS (SELECT incident_id, count(*) AS n FROM an GROUP BY 1), c AS (SELECT incident_id, count(*) AS n FROM corr GROUP BY 1),
    r AS (SELECT incident_id, count(*) AS n FROM rel GROUP BY 1),
    ch AS (SELECT incident_id, string_agg(node_id, ' -> ' ORDER BY position) AS chain FROM nodes GROUP BY 1)
    SELECT ass.incident_id, coalesce(e.n, 0) || ' timeline entries; ' || coalesce(c.n, 0) || ' temporal correlations; '
      || CASE WHEN here AND strong AND NOT fatal AND rscore >= 0.4 THEN 'deployment related' ELSE 'deployment not related' END || '; '
      || coalesce(r.n, 0) || ' service relationships' AS summary, 'Evidence chain: ' || chain AS graph_summary
    FROM ass LEFT JOIN e USING (incident_id) LEFT JOIN c USING (incident_id) LEFT JOIN r USING (incident_id) LEFT JOIN ch USING (incident_id)""",
)
def p5(t):
    return TL.evidence_package(*built(t)).select("incident_id", "summary", "graph_summary")


ITEMS_SQL = """it AS (
      SELECT incident_id, 'symptoms' AS section, us, id FROM an WHERE category IN ('alert', 'log')
      UNION ALL SELECT incident_id, 'error_groups', us, id FROM an WHERE category = 'error'
      UNION ALL SELECT incident_id, 'anomalies', us, id FROM an WHERE category = 'metric' AND anomaly
      UNION ALL SELECT incident_id, 'deployments', us, id FROM an WHERE category = 'deployment'
      UNION ALL SELECT incident_id, 'timeline', us, id FROM an)"""


@query(
    "p7_package_items",
    tl_sql(Q.MARK, Q.CORR, A8, *ALL_REL)
    + """, """ + ITEMS_SQL + """
    SELECT incident_id, section, row_number() OVER (PARTITION BY incident_id, section ORDER BY us, id) AS pos, id FROM it
    UNION ALL SELECT incident_id, 'correlations', n, NULL FROM (
      SELECT incident_id, unnest(range(1, count(*) + 1)) AS n FROM (
        SELECT incident_id FROM corr UNION ALL SELECT incident_id FROM rel UNION ALL SELECT incident_id FROM ass) GROUP BY 1)""",
)
def p7(t):
    tl = TL.build_timelines(t.incidents, t.events, t.groups, t.services, NOW)
    names = F.array(*[F.lit(s) for s in P.SECTIONS])
    return P.package_items(tl).select(
        "incident_id", names[F.col("section")].alias("section"), "pos", F.get_json_object("item", "$.id").alias("id")
    )


@query(
    "a19_consistency_scores",
    tl_sql(Q.MARK, Q.CORR, A8, *ALL_REL, CHAIN_SQL, EDGE_SQL)
    + """, pc AS (SELECT incident_id, round(score, 4) AS s FROM corr UNION ALL SELECT incident_id, score FROM rel UNION ALL SELECT incident_id, rscore FROM ass),
    tm AS (SELECT incident_id, CAST(CAST(sum(s::DECIMAL(18, 4))::DOUBLE / count(*) AS VARCHAR) AS DECIMAL(18, 4))::DOUBLE AS temporal_score FROM pc GROUP BY 1),
    cn AS (SELECT incident_id, least(1.0e0, count(*) / 5.0e0) AS c FROM nodes GROUP BY 1), ce AS (SELECT incident_id, sum(confidence::DECIMAL(18, 6))::DOUBLE / count(*) AS e FROM edges GROUP BY 1)
    SELECT incident_id, coalesce(temporal_score, 0.0) AS temporal_score, CAST(CAST(CASE WHEN e IS NULL THEN c ELSE 0.6e0 * c + 0.4e0 * e END AS VARCHAR) AS DECIMAL(18, 4))::DOUBLE AS dependency_score
    FROM cn LEFT JOIN ce USING (incident_id) LEFT JOIN tm USING (incident_id)""",
)
def a19(t):
    tl, ev = built(t)
    s = evidence.consistency_scores(P.package_correlations(tl), ev.nodes, ev.edges)
    return s.select("incident_id", "temporal_score", "dependency_score")


@query("s19_package_json")
def s19(t):
    tl, ev = built(t)
    return P.package_json(P.rca_package(tl, ev, P.package_items(tl)))


@query(
    "s19_documents",
    tl_sql(Q.MARK, Q.CORR, A8, *ALL_REL)
    + ", " + ITEMS_SQL + f""", lk AS (SELECT incident_id FROM corr UNION ALL SELECT incident_id FROM rel UNION ALL SELECT incident_id FROM ass),
    fld AS (SELECT unnest({list(D.FIELDS)}) AS field),
    pc AS (
      SELECT id AS incident_id, field, 0 AS step, 0 AS us, '' AS o, field AS key FROM inc, fld
      UNION ALL SELECT id, field, 2, 0, '', 'end' FROM inc, fld WHERE field NOT IN ({", ".join(f"'{x}'" for x in D.FIXED)})
      UNION ALL SELECT incident_id, section, 1, us, id, id FROM it
      UNION ALL SELECT incident_id, 'correlations', 1, 0, '', 'link' FROM lk)
    SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY field, step, us, o) - 1 AS line, key FROM pc""",
)
def s19_documents(t):
    """Every line of every document as read back from its part files: fields, items by id, links, ends."""
    tl, ev = built(t)
    path = shared_path(t.spark, "documents")
    frame = P.package_frame(tl, ev).withColumn("evidence_graph", P.graph_json())
    D.write_documents(P.package_items(tl), frame, path, rows_per_part=20_000)
    body = F.regexp_replace("text", "^,", "")
    name = F.nullif(F.regexp_extract("text", f'^[{{,]"({"|".join(D.FIELDS)})":', 1), F.lit(""))
    found = F.coalesce(F.get_json_object(body, "$.id"), F.when(F.get_json_object(body, "$.kind").isNotNull(), "link"))
    key = F.when(F.col("text").startswith("]"), "end").otherwise(F.coalesce(name, found))
    return D.read_documents(t.spark, path).select("incident_id", "line", key.alias("key"))


@query("x34_package_keys")
def x34(t):
    from faultline.operators.evaluate import package_keys

    tl = TL.build_timelines(t.incidents, t.events, t.groups, t.services, NOW)
    return package_keys(P.package_items(tl)).select("incident_id", "key", "first_use.section", "first_use.pos", "first_use.sub")


@query("p11_investigate")
def p11(t):
    from faultline.plans.investigate import investigate

    events = t.events.withColumn("service", F.lit(None).cast("string"))
    inv = investigate(t.incidents, events, t.services, NOW, NOW, history=t.incidents)
    return inv.packages.select("incident_id", "item_count", "score", F.size("timeline").alias("entries"), "historical_context")
