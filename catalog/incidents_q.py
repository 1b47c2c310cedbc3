"""Incident, similarity, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import roles_sql as Q
from catalog.roles import NOW
from faultline.functions import scores as C
from faultline.functions import text as S
from faultline.operators import evaluate as V
from faultline.operators import incidents as I
from faultline.operators import rank as R
from faultline.operators import similar as M
from faultline.operators.concordance import concordance


def alerts(t):
    """Orders as an alert sequence; a finished order is a resolved alert."""
    return t.wide("orders").selectExpr(
        "1 + o_custkey % 5 as project_id",
        "o_orderkey as seq",
        "if(o_orderstatus = 'F', 'RESOLVED', 'FIRING') as status",
        "if(o_custkey % 10 = 0, null, o_custkey % 7) as service_id",
        "if(o_custkey % 2 = 0, ' Production', 'staging ') as environment",
        "concat('Backlog of ', substring(o_orderpriority, 3), ' order ', o_orderkey) as title",
        "if(o_totalprice > 250000, 'HIGH', null) as severity",
        "timestamp_micros(1704067200000000 + o_orderkey * 60000000) as timestamp",
    )


ALERTS = """al AS (
  SELECT 1 + o_custkey % 5 AS project_id, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'FIRING' END AS status,
    CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey % 7 END AS service_id, CASE WHEN o_custkey % 2 = 0 THEN 'production' ELSE 'staging' END AS env,
    'Backlog of ' || substring(o_orderpriority, 3) || ' order ' || o_orderkey AS title, 'Backlog of ' || substring(o_orderpriority, 3) || ' order {id}' AS identity,
    CASE WHEN o_totalprice > 250000 THEN 'HIGH' END AS severity, 1704067200000000 + o_orderkey * 60000000 AS us FROM orders),
act AS (
  SELECT *, coalesce(lag(status) OVER w, 'RESOLVED') AS before, coalesce(sum(CASE WHEN status = 'RESOLVED' THEN 1 ELSE 0 END)
    OVER (PARTITION BY project_id, service_id, env, identity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS episode
  FROM al WINDOW w AS (PARTITION BY project_id, service_id, env, identity ORDER BY seq)),
outc AS (
  SELECT *, CASE WHEN status = 'FIRING' THEN CASE WHEN before = 'FIRING' THEN 'MERGED' ELSE 'CREATED' END
    ELSE CASE WHEN before = 'FIRING' THEN 'RESOLVED' ELSE 'UNMATCHED' END END AS action FROM act)"""


@query("j14_apply_alerts", Q.cte(ALERTS) + " SELECT project_id, seq, action FROM outc")
def j14(t):
    return I.apply_alerts(alerts(t)).select("project_id", "seq", "action")


@query("w11_episodes", Q.cte(ALERTS) + " SELECT project_id, seq, episode FROM outc")
def w11(t):
    return I.episodes(I.apply_alerts(alerts(t))).select("project_id", "seq", "episode")


@query(
    "a5_merge_incidents",
    Q.cte(ALERTS)
    + """ SELECT project_id, episode, arg_min(title, seq) FILTER (WHERE status = 'FIRING') AS title, any_value(env) AS environment,
      arg_min(coalesce(severity, 'MEDIUM'), seq) FILTER (WHERE status = 'FIRING') AS severity, any_value(service_id) AS service_id,
      min(us) FILTER (WHERE status = 'FIRING') AS started_us, max(us) FILTER (WHERE status = 'RESOLVED') AS ended_us,
      count(*) FILTER (WHERE status = 'FIRING') AS occurrence_count,
      CASE WHEN max(us) FILTER (WHERE status = 'RESOLVED') IS NULL THEN 'OPEN' ELSE 'RESOLVED' END AS status
    FROM outc WHERE action <> 'UNMATCHED' GROUP BY project_id, service_id, env, identity, episode
    HAVING count(*) FILTER (WHERE status = 'FIRING') > 0""",
)
def a5(t):
    m = I.merge_incidents(I.apply_alerts(alerts(t)))
    return m.selectExpr(
        "project_id",
        "episode",
        "title",
        "environment",
        "severity",
        "service_id",
        "unix_micros(started_at) as started_us",
        "unix_micros(ended_at) as ended_us",
        "occurrence_count",
        "status",
    )


@query(
    "a13_outcome_totals",
    Q.cte(ALERTS)
    + """ SELECT project_id, count(*) AS alerts_received, count(*) FILTER (WHERE action = 'CREATED') AS incidents_created,
      count(*) FILTER (WHERE action = 'MERGED') AS incidents_merged, count(*) FILTER (WHERE action = 'RESOLVED') AS incidents_resolved
    FROM outc GROUP BY 1""",
)
def a13(t):
    return I.outcome_totals(I.apply_alerts(alerts(t)))


STAT = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS status_{s.lower()}" for s in I.STATUSES)
SEVS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS severity_{s.lower()}" for s in I.SEVERITIES)


@query(
    "a6_incident_summary",
    Q.cte(Q.INC)
    + f""" SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status IN ('OPEN', 'INVESTIGATING', 'IDENTIFIED')) AS active,
    count(*) FILTER (WHERE severity = 'CRITICAL' AND status IN ('OPEN', 'INVESTIGATING', 'IDENTIFIED')) AS critical_active,
    count(*) FILTER (WHERE started_us >= {Q.NOW_US} - 168 * 3600000000) AS recent, {STAT}, {SEVS} FROM inc GROUP BY 1""",
)
def a6(t):
    return I.incident_summary(t.incidents, NOW, hours=168)


@query(
    "k2_list_incidents",
    Q.cte(Q.INC)
    + """ SELECT id, started_us, severity, status FROM inc WHERE severity IN ('CRITICAL', 'HIGH') AND status IN ('OPEN', 'IDENTIFIED')
    ORDER BY started_us DESC, id DESC LIMIT 20 OFFSET 20""",
)
def k2(t):
    page = I.list_incidents(t.incidents, ["CRITICAL", "HIGH"], ["OPEN", "IDENTIFIED"], page=2)
    return page.selectExpr("id", "unix_micros(started_at) as started_us", "severity", "status")


@query(
    "w12_s20_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def w12(t):
    o = t.table("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return I.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "x28_term_freq",
    """WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token FROM documents),
    n AS (SELECT doc_id, token, count(*) AS c FROM k GROUP BY 1, 2)
    SELECT doc_id, token, round(c / sum(c) OVER (PARTITION BY doc_id), 9) AS tf FROM n""",
)
def x28(t):
    d = t.table("documents").select("doc_id", F.explode(S.tokens(F.col("text"))).alias("token"))
    counts = d.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("doc_id").agg(F.sum("c").alias("n"))
    return counts.join(total, "doc_id").select("doc_id", "token", F.round(F.col("c") / F.col("n"), 9).alias("tf"))


TF = """pt AS (SELECT p_partkey AS id, p_brand AS b, lower(p_name || ' ' || p_type) AS text FROM part),
fst AS (SELECT b, arg_min(text, id) AS ft FROM pt GROUP BY 1),
lt AS (SELECT id, unnest(regexp_extract_all(text, '[a-z0-9]{2,}')) AS tok FROM pt),
lf AS (SELECT id, tok, count(*)::DOUBLE AS c FROM lt GROUP BY 1, 2),
rt AS (SELECT b, unnest(regexp_extract_all(ft, '[a-z0-9]{2,}')) AS tok FROM fst),
rf AS (SELECT b, tok, count(*)::DOUBLE AS c FROM rt GROUP BY 1, 2)"""


@query(
    "a12_tf_cosine",
    Q.cte(TF)
    + """, ln AS (SELECT id, sqrt(sum(c * c)) AS n FROM lf GROUP BY 1), rn AS (SELECT b, sqrt(sum(c * c)) AS n FROM rf GROUP BY 1),
    dt AS (SELECT pt.id, sum(lf.c * rf.c) AS d FROM pt JOIN lf ON lf.id = pt.id JOIN rf ON rf.b = pt.b AND rf.tok = lf.tok GROUP BY 1)
    SELECT pt.id, round(coalesce(d, 0) / (ln.n * rn.n), 4) AS cosine FROM pt JOIN ln ON ln.id = pt.id JOIN rn ON rn.b = pt.b LEFT JOIN dt ON dt.id = pt.id""",
)
def a12(t):
    p = t.table("part").selectExpr("p_partkey as id", "p_brand as b", "concat(p_name, ' ', p_type) as text")
    first = p.groupBy("b").agg(F.min_by("text", "id").alias("ft"))
    cosine = C.map_cosine(S.term_freq(F.col("text")), S.term_freq(F.col("ft")))
    return p.join(first, "b").select("id", cosine.alias("cosine"))


@query(
    "a11_jaccard",
    """WITH p AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS a, [lower(p_type), lower(split_part(p_name, ' ', 1))] AS b FROM part)
    SELECT id, round(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM p""",
)
def a11(t):
    p = t.table("part")
    a, b = F.split("p_name", " "), F.array(F.col("p_type"), F.split("p_name", " ")[0])
    return p.select(F.col("p_partkey").alias("id"), F.round(C.jaccard(a, b), 6).alias("jaccard"))


def sim_incidents(t):
    """Customers' order backlogs worded by segment, so that titles resemble each other."""
    c = t.table("customer").join(t.table("orders"), F.expr("c_custkey = o_custkey")).groupBy("c_custkey", "c_mktsegment", "c_nationkey")
    g = c.agg(F.min("o_orderpriority").alias("p"), F.min_by("o_orderstatus", "o_orderkey").alias("s"))
    from faultline.functions.fingerprints import incident_fingerprint

    rows = g.selectExpr(
        "c_custkey as id",
        "cast(1 + c_nationkey % 5 as bigint) as project_id",
        "cast(c_nationkey as bigint) as service_id",
        "if(c_custkey % 3 = 0, 'staging', 'production') as environment",
        "concat(lower(substring(p, 3)), ' order backlog in ', lower(c_mktsegment), ' for customer ', c_custkey) as title",
        "case s when 'F' then 'RESOLVED' when 'P' then 'IDENTIFIED' else 'OPEN' end as status",
        "timestamp_micros(1704067200000000 + (c_custkey * 37 % 41760) * 60000000) as started_at",
    )
    return rows.withColumn("fingerprint", incident_fingerprint(F.col("service_id"), F.col("environment"), F.col("title")))


def rca_results(t):
    """A result of root-cause analysis for each order; some have no hypothesis."""
    title = "if(o_orderkey % 4 = 0, '', concat('late supply of ', lower(substring(o_orderpriority, 3))))"
    return t.table("orders").selectExpr(
        "o_orderkey as id",
        "o_custkey as incident_id",
        "timestamp_micros(1704067200000000 + o_orderkey % 9973 * 1000000) as created_at",
        f"to_json(named_struct('primary_hypothesis', named_struct('title', {title}))) as result_data",
    )


SIMILAR = f"""WITH RECURSIVE {Q.SVC},
g AS (SELECT c_custkey AS id, 1 + c_nationkey % 5 AS project_id, c_nationkey AS service_id, CASE WHEN c_custkey % 3 = 0 THEN 'staging' ELSE 'production' END AS environment,
    lower(substring(min(o_orderpriority), 3)) || ' order backlog in ' || lower(c_mktsegment) || ' for customer ' || c_custkey AS title,
    CASE arg_min(o_orderstatus, o_orderkey) WHEN 'F' THEN 'RESOLVED' WHEN 'P' THEN 'IDENTIFIED' ELSE 'OPEN' END AS status,
    1704067200000000 + (c_custkey * 37 % 41760) * 60000000 AS started_at
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey),
h AS (SELECT o_custkey AS id, arg_max(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'late supply of ' || lower(substring(o_orderpriority, 3)) END, (o_orderkey % 9973, o_orderkey)) AS hypothesis FROM orders GROUP BY 1),
i AS (SELECT g.*, {Q.pattern('title')} AS identity, coalesce(' ' || svc.name, '') AS service_name, CASE WHEN hypothesis = '' THEN '' ELSE ' ' || hypothesis END AS prior
  FROM g LEFT JOIN svc ON svc.id = g.service_id LEFT JOIN h ON h.id = g.id),
x AS (SELECT *, title || ' ' || identity || ' ' || environment || service_name AS text FROM i),
tok AS (SELECT side, id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS token FROM (
  SELECT 's' AS side, id, text FROM x UNION ALL SELECT 'c', id, text || prior FROM x WHERE status IN ('IDENTIFIED', 'RESOLVED', 'CLOSED'))),
tf AS (SELECT side, id, token, count(*) / CAST(sum(count(*)) OVER (PARTITION BY side, id) AS DOUBLE) AS w FROM tok GROUP BY side, id, token),
norm AS (SELECT side, id, sqrt(sum(w * w)) AS norm FROM tf GROUP BY 1, 2),
pr AS (SELECT s.id AS s, c.id AS c, s.project_id, s.identity AS a, c.identity AS b, s.service_id = c.service_id AS svc, s.environment = c.environment AS env, c.title, c.started_at, c.prior
  FROM x s JOIN x c ON c.project_id = s.project_id AND c.id <> s.id AND c.status IN ('IDENTIFIED', 'RESOLVED', 'CLOSED')),
{Q.ratios('pr')},
dot AS (SELECT s.id AS s, c.id AS c, sum(s.w * c.w) AS dot FROM tf s JOIN tf c ON c.token = s.token AND c.side = 'c' JOIN pr ON pr.s = s.id AND pr.c = c.id WHERE s.side = 's' GROUP BY 1, 2),
cs AS (SELECT pr.*, ratio, a = b AND svc AND env AS same, {Q.half_up('coalesce(dot / (ns.norm * nc.norm), 0.0)', 4)} AS cosine
  FROM pr JOIN ratio USING (a, b) LEFT JOIN dot ON dot.s = pr.s AND dot.c = pr.c JOIN norm ns ON ns.side = 's' AND ns.id = pr.s JOIN norm nc ON nc.side = 'c' AND nc.id = pr.c),
sc AS (SELECT *, CASE WHEN same THEN 0.95 ELSE {Q.half_up('(ratio * 0.3 + cosine * 0.25 + CASE WHEN svc THEN 0.1 ELSE 0.0 END + CASE WHEN env THEN 0.1 ELSE 0.0 END)', 4)} END AS score FROM cs),
top AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, started_at, c) AS rank FROM sc WHERE score >= 0.55 QUALIFY rank <= 5)"""


def _similar(t):
    i = sim_incidents(t)
    return M.similar_incidents(M.profiles(i, t.services), M.historical_candidates(i, rca_results(t), t.services))


@query(
    "k1_j16_x29_similar_incidents",
    SIMILAR
    + """ SELECT s AS incident_id, project_id, rank, c AS candidate_id, title AS candidate_title, score, started_at, nullif(substr(prior, 2), '') AS hypothesis,
    concat_ws(',', CASE WHEN cosine >= 0.5 THEN 'embedding' END, CASE WHEN env THEN 'environment' END, CASE WHEN same THEN 'fingerprint' END,
      CASE WHEN svc THEN 'service' END, CASE WHEN ratio >= 0.75 THEN 'title' END) AS signals FROM top""",
)
def k1(t):
    return _similar(t).withColumn("signals", F.array_join("signals", ",")).withColumn("started_at", F.unix_micros("started_at"))


@query(
    "p8_historical_context",
    SIMILAR
    + f""" SELECT s AS incident_id, count(*) AS prior_incident_count, '{M.DISCLAIMER}; ' || string_agg('Incident ' || c || ' (' || title || ') scored ' || printf('%.2f', {Q.half_up('score', 2)})
      || ' similarity' || CASE WHEN prior = '' THEN '' ELSE '; prior RCA hypothesis: ' || substr(prior, 2) END, '; ' ORDER BY rank) AS notes FROM top GROUP BY s""",
)
def p8(t):
    return M.historical_context(_similar(t)).select("incident_id", "prior_incident_count", F.array_join("notes", "; ").alias("notes"))


@query(
    "x29_embedding_text",
    Q.cte(Q.INC, Q.SVC)
    + f""" SELECT inc.id, title || ' ' || {Q.pattern('title')} || ' ' || environment || coalesce(' ' || svc.name, '') AS text
    FROM inc LEFT JOIN svc ON svc.id = inc.service_id""",
)
def x29(t):
    return M.profiles(t.incidents, t.services).select("id", "text")


CAND = """SELECT o_orderkey AS id, o_custkey AS incident_id, 'cause ' || substring(o_orderpriority, 3) || ' ' || o_orderkey AS title,
  CAST(CAST(o_totalprice / 500000 AS VARCHAR) AS DECIMAL(18, 4))::DOUBLE AS confidence FROM orders"""


def candidates(t):
    null = F.lit(None).cast("double")
    return t.table("orders").selectExpr(
        "o_custkey as incident_id",
        "concat('cause ', substring(o_orderpriority, 3), ' ', o_orderkey) as title",
        "round(o_totalprice / 500000, 4) as confidence",
    ).withColumns({"temporal_score": F.when(F.col("confidence") > 0.5, 0.8).otherwise(null), "dependency_score": null})


def package_scores(t):
    c = t.table("customer")
    return c.selectExpr("c_custkey as incident_id", "0.5D as temporal_score", "(c_custkey % 10) / 10D as dependency_score")


RANKED = f"""cd AS ({CAND}),
cs AS (SELECT cd.*, CASE WHEN confidence > 0.5 THEN round((0.8e0 + 0.5e0) / 2, 4) ELSE 0.5e0 END AS ts, (incident_id % 10) / 10e0 AS ds FROM cd),
cb AS (SELECT *, CAST(CAST(0.5e0 * confidence + 0.25e0 * ts + 0.25e0 * ds AS VARCHAR) AS DECIMAL(18, 4))::DOUBLE AS combined FROM cs),
rk AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY combined DESC, title) AS rank FROM cb)"""


@query("w13_rank_hypotheses", Q.cte(RANKED) + " SELECT incident_id, title, combined, CAST(rank AS INTEGER) AS rank FROM rk")
def w13(t):
    r = R.rank_hypotheses(candidates(t), package_scores(t))
    return r.select("incident_id", "title", "combined", "rank")


@query(
    "p10_finalize",
    Q.cte(RANKED)
    + """, q AS (SELECT c_custkey AS incident_id, c_custkey % 100 AS score FROM customer), tp AS (SELECT * FROM rk WHERE rank = 1)
    SELECT tp.incident_id, CASE WHEN score < 30 OR combined < 0.6 THEN 'no_confident_root_cause' WHEN combined < 0.75 THEN 'low_confidence' ELSE 'confident' END AS status,
      CASE WHEN score < 30 OR combined < 0.6 THEN NULL ELSE title END AS primary_title, CASE WHEN score < 30 OR combined < 0.6 THEN 0.0 ELSE combined END AS confidence,
      score AS evidence_quality, (SELECT count(*) - 1 FROM rk WHERE rk.incident_id = tp.incident_id) AS alternatives
    FROM tp JOIN q USING (incident_id)""",
)
def p10(t):
    ranked = R.rank_hypotheses(candidates(t), package_scores(t))
    quality = t.table("customer").selectExpr("c_custkey as incident_id", "c_custkey % 100 as score")
    f = R.finalize(ranked, quality)
    return f.withColumn("alternatives", F.size("alternatives").cast("bigint"))


@query(
    "p9_sufficient",
    "SELECT c_custkey AS incident_id FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey "
    "WHERE c_custkey % 100 >= 30 AND coalesce(n, 0) > 0",
)
def p9(t):
    n = t.table("orders").groupBy(F.col("o_custkey").alias("incident_id")).agg(F.count(F.lit(1)).alias("signals"))
    q = t.table("customer").selectExpr("c_custkey as incident_id", "c_custkey % 100 as score").join(n, "incident_id", "left")
    return R.sufficient(q).select("incident_id")


def cases(t):
    """Labelled documents as scored cases: confidence from length, correct from quality."""
    d = t.table("documents").join(t.table("labels"), "doc_id")
    return d.selectExpr(
        "doc_id as case_id",
        "source as backend",
        "quality = 1 as accurate",
        "1D / (1 + doc_id % 4) as reciprocal_rank",
        "if(doc_id % 3 = 0, null, (doc_id % 5) / 4D) as ranking_kendall_tau",
        "if(doc_id % 2 = 0, null, 0.5D) as grounding_precision",
        "if(doc_id % 2 = 0, null, 0.25D) as grounding_recall",
        "if(doc_id % 2 = 0, null, 1D / 3) as grounding_f1",
        "toxic / 1D as hallucination_rate",
        "least(1D, n_chars / 5000D) as confidence",
        "if(doc_id % 11 = 0, 'timeout', null) as error",
    )


CASES = """cs AS (SELECT d.doc_id AS case_id, source AS backend, (quality = 1) AS accurate, 1e0 / (1 + d.doc_id % 4) AS rr,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE (d.doc_id % 5) / 4e0 END AS tau, CASE WHEN d.doc_id % 2 = 0 THEN NULL ELSE 1e0 / 3 END AS f1,
  toxic / 1e0 AS hr, least(1e0, n_chars / 5000e0) AS confidence, d.doc_id % 11 = 0 AS failed FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
ok AS (SELECT * FROM cs WHERE NOT failed),
bn AS (SELECT backend, least(floor(confidence * 10), 9)::BIGINT AS bin, count(*) AS n, avg(confidence) AS mc, avg(accurate::INT) AS acc FROM ok GROUP BY 1, 2),
ece AS (SELECT backend, sum(n * abs(mc - acc)) / sum(n) AS e FROM bn GROUP BY 1)"""


@query(
    "a17_calibration",
    Q.cte(CASES)
    + """, bk AS (SELECT DISTINCT backend FROM cs), al AS (SELECT backend, unnest(range(10)) AS bin FROM bk)
    SELECT al.backend, al.bin, coalesce(n, 0) AS n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM al LEFT JOIN bn ON bn.backend = al.backend AND bn.bin = al.bin""",
)
def a17(t):
    c = V.calibration(cases(t))
    return c.select("backend", "bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "a16_aggregate_scores",
    Q.cte(CASES)
    + """ SELECT cs.backend, count(*) FILTER (WHERE NOT failed) AS cases_evaluated, count(*) FILTER (WHERE failed) AS cases_failed,
      round(avg(accurate::INT) FILTER (WHERE NOT failed), 6) AS rca_accuracy, round(avg(rr) FILTER (WHERE NOT failed), 6) AS mean_reciprocal_rank,
      round(avg(tau) FILTER (WHERE NOT failed), 6) AS mean_ranking_kendall_tau, round(avg(hr) FILTER (WHERE NOT failed), 6) AS mean_hallucination_rate,
      round(avg(confidence) FILTER (WHERE NOT failed AND accurate), 6) AS mean_confidence_when_correct, round(any_value(e), 6) AS expected_calibration_error
    FROM cs LEFT JOIN ece USING (backend) GROUP BY 1""",
)
def a16(t):
    a = V.aggregate_scores(cases(t))
    names = (
        "rca_accuracy",
        "mean_reciprocal_rank",
        "mean_ranking_kendall_tau",
        "mean_hallucination_rate",
        "mean_confidence_when_correct",
        "expected_calibration_error",
    )
    return a.select("backend", "cases_evaluated", "cases_failed", *[F.round(n, 6).alias(n) for n in names])


@query(
    "a18_comparison",
    Q.cte(CASES)
    + """, ag AS (SELECT backend, avg(accurate::INT) AS rca_accuracy, avg(rr) AS mean_reciprocal_rank, avg(tau) AS mean_ranking_kendall_tau,
      avg(f1) AS mean_grounding_f1, avg(hr) AS mean_hallucination_rate, any_value(e) AS expected_calibration_error FROM ok LEFT JOIN ece USING (backend) GROUP BY 1),
    up AS (UNPIVOT ag ON rca_accuracy, mean_reciprocal_rank, mean_ranking_kendall_tau, mean_grounding_f1, mean_hallucination_rate, expected_calibration_error INTO NAME metric VALUE score)
    SELECT metric, round(max(score) FILTER (WHERE backend = 'src1'), 6) AS src1, round(max(score) FILTER (WHERE backend = 'src2'), 6) AS src2,
      round(max(score) FILTER (WHERE backend = 'src7'), 6) AS src7 FROM up GROUP BY 1""",
)
def a18(t):
    backends = ["src1", "src2", "src7"]
    c = V.comparison(V.aggregate_scores(cases(t)), backends)
    return c.select("metric", *[F.round(b, 6).alias(b) for b in backends])


def predictions(t):
    """Each part as a case: its words in turn are the ranked titles."""
    p = t.table("part")
    return p.selectExpr(
        "p_partkey as case_id",
        "lower(p_brand) as backend",
        "array(concat('Slow ', p_name), p_type, concat('retry storm ', p_size)) as titles",
        "if(p_partkey % 6 = 0, null, concat('Slow ', p_name)) as primary_title",
        "array(concat('event:', p_partkey), concat('group:', p_size), p_type) as cited_keys",
        "least(1D, p_retailprice / 2000) as confidence",
        "if(p_partkey % 6 = 0, 'no_confident_root_cause', 'confident') as status",
        "cast(null as string) as error",
    )


def gold(t):
    p = t.table("part")
    return p.selectExpr(
        "p_partkey as case_id",
        "split(p_name, ' ')[0] as root_cause_title",
        "array(p_type) as root_cause_aliases",
        "if(p_partkey % 12 = 0, 'no_confident_root_cause', 'confident') as expected_status",
        "false as allow_no_root_cause",
        "array(p_type, split(p_name, ' ')[0]) as ranked_hypothesis_titles",
        "array(concat('event:', p_partkey), 'missing key') as supporting_evidence_keys",
        "array(concat('Group ', p_size), 'nothing else') as valid_evidence_keys",
    )


@query(
    "a15_j18_w10_score_cases",
    """WITH p AS (SELECT p_partkey AS k, p_name, lower(p_type) AS ty, split_part(p_name, ' ', 1) AS w, p_partkey % 6 = 0 AS none, p_partkey % 12 = 0 AS abst,
        p_size FROM part),
      m AS (SELECT *, contains('slow ' || p_name, w) OR contains('slow ' || p_name, ty) AS m1,
        contains(ty, w) OR contains(w, ty) OR true AS m2 FROM p)
    SELECT k AS case_id, CASE WHEN abst THEN none ELSE (NOT none AND m1) END AS accurate, CAST(CASE WHEN m1 THEN 1 ELSE 2 END AS BIGINT) AS primary_rank,
      CASE WHEN m1 THEN 1.0e0 ELSE 0.5e0 END AS reciprocal_rank, round(1e0 / 3, 6) AS grounding_precision, 0.5e0 AS grounding_recall,
      round(1e0 / 3, 6) AS hallucination_rate FROM m""",
)
def a15(t):
    s = V.score_cases(predictions(t), gold(t))
    return s.select(
        "case_id",
        "accurate",
        "primary_rank",
        "reciprocal_rank",
        F.round("grounding_precision", 6).alias("grounding_precision"),
        "grounding_recall",
        F.round("hallucination_rate", 6).alias("hallucination_rate"),
    )


@query(
    "w10_kendall_tau",
    """WITH s AS (SELECT l_orderkey AS k, row_number() OVER () AS id, (l_linenumber, l_extendedprice) AS a, (l_extendedprice, l_linenumber) AS b FROM lineitem),
    p AS (SELECT x.k, CASE WHEN x.a = y.a THEN 0 WHEN (x.a < y.a) = (x.b < y.b) THEN 1 ELSE -1 END AS sign FROM s x JOIN s y ON x.k = y.k AND x.id < y.id)
    SELECT s.k AS l_orderkey, count(*) AS n, any_value(t.tau) AS tau FROM s LEFT JOIN (SELECT k, round(avg(sign), 6) AS tau FROM p GROUP BY 1) t ON s.k = t.k GROUP BY 1""",
)
def w10(t):
    """Line order against price order within each order; what ties in one follows the other."""
    line, price = F.col("l_linenumber"), F.col("l_extendedprice")
    c = concordance(t.table("lineitem"), ["l_orderkey"], F.struct(line, price), F.struct(price, line))
    return c.select("l_orderkey", "n", F.round("tau", 6).alias("tau"))
