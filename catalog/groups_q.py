"""Normalization, fingerprint, grouping and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog import roles_sql as Q
from faultline.functions import fingerprints as FP
from faultline.functions import text as S
from faultline.operators import groups as G

FPR = Q.fingerprint("'LOG'", "pattern", "service", "severity", "''")
FPS = Q.fingerprint("'LOG'", "pattern", "service", "severity", "file")
FREC = f"frec AS (SELECT *, {FPR} AS fingerprint FROM rec)"


@query("x8_x10_message_pattern", Q.cte(Q.LINES) + f" SELECT doc_id, line_number, {Q.ws('line')} AS message, {Q.pattern('line')} AS pattern FROM lines")
def x10(t):
    line = F.col("line")
    return t.lines.select("doc_id", "line_number", S.norm_ws(line).alias("message"), S.message_pattern(line).alias("pattern"))


@query(
    "x11_share_pattern",
    Q.cte(Q.LINES, Q.REC)
    + """, p AS (SELECT doc_id, pattern, lag(pattern) OVER (PARTITION BY doc_id ORDER BY line_number) AS before FROM rec)
    SELECT doc_id, count(*) FILTER (WHERE pattern IS NOT DISTINCT FROM before) AS repeats FROM p GROUP BY 1""",
)
def x11(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_number")
    pairs = t.lines.select("doc_id", "line", F.lag("line").over(w).alias("before"))
    same = S.share_pattern(F.col("line"), F.col("before"))
    return pairs.groupBy("doc_id").agg(F.count_if(same).alias("repeats"))


@query(
    "x12_event_fingerprint",
    Q.cte(Q.LINES, Q.REC) + f" SELECT doc_id, line_number, {FPS} AS fingerprint FROM rec",
)
def x12(t):
    r = t.records
    fp = FP.event_fingerprint(F.lit("LOG"), F.col("file"), F.col("service"), F.col("severity"), F.col("normalized_message"))
    return r.select("doc_id", "line_number", fp.alias("fingerprint"))


@query("x13_logical_fingerprint", Q.cte(Q.LINES, Q.REC, FREC) + " SELECT fingerprint, count(*) AS n FROM frec GROUP BY 1")
def x13(t):
    return G.frequency(t.records, "fingerprint")


@query(
    "x14_incident_fingerprint",
    Q.cte(Q.INC)
    + f""" SELECT id, sha256('{{"environment":' || {Q.json_text('environment')} || ',"problem_identity":' || {Q.json_text(Q.pattern('title'))}
    || ',"service_id":"' || coalesce(CAST(service_id AS VARCHAR), '') || '"}}') AS fingerprint, {Q.pattern('title')} AS identity FROM inc""",
)
def x14(t):
    return t.incidents.select("id", "fingerprint", FP.problem_identity(F.col("title")).alias("identity"))


@query(
    "a1_error_groups",
    Q.cte(Q.LINES, Q.REC, FREC)
    + """ SELECT project_id, fingerprint, any_value(pattern) AS normalized_message, any_value(severity) AS severity, any_value(service) AS service,
    count(*) AS occurrence_count, min(us) AS first_us, max(us) AS last_us FROM frec WHERE pattern IS NOT NULL GROUP BY 1, 2""",
)
def a1(t):
    g = G.error_groups(t.records.withColumn("seq", F.expr("doc_id * 1000000 + line_number")))
    return g.selectExpr(
        "project_id",
        "fingerprint",
        "normalized_message",
        "severity",
        "service",
        "occurrence_count",
        "unix_micros(first_seen) as first_us",
        "unix_micros(last_seen) as last_us",
    )


@query(
    "a3_dedupe",
    Q.cte(Q.LINES, Q.REC, FREC)
    + """ SELECT doc_id, line_number, message, fingerprint FROM (
      SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id, line_number) AS r FROM frec) WHERE r = 1""",
)
def a3(t):
    return G.dedupe(t.records, ["doc_id", "line_number"]).select("doc_id", "line_number", "message", "fingerprint")


@query(
    "a3_dedupe_totals",
    Q.cte(Q.LINES, Q.REC, FREC)
    + " SELECT count(*) AS parsed, count(DISTINCT fingerprint) AS kept, count(*) - count(DISTINCT fingerprint) AS removed FROM frec",
)
def a3b(t):
    return G.dedupe_totals(t.records)


@query("a4_severity_frequency", Q.cte(Q.LINES, Q.REC) + " SELECT severity, count(*) AS n FROM rec GROUP BY 1")
def a4(t):
    return G.frequency(t.records, "severity")


def patterns(t):
    """Order titles and part names: short messages that repeat with small changes."""
    return t.table("part").selectExpr(
        "1 + p_partkey % 5 as project_id",
        "p_partkey as id",
        "concat(p_name, ' ', lower(p_brand), ' ', lower(p_type)) as pattern",
        "if(p_partkey % 4 = 0, null, p_size % 8) as service_id",
        "p_partkey as arrival",
        "cast(1 + p_partkey % 3 as bigint) as occurrence_count",
        "timestamp_micros(1704067200000000 + p_partkey * 60000000) as first_seen",
        "timestamp_micros(1704067200000000 + p_partkey * 120000000) as last_seen",
        "'HIGH' as severity",
    )


def distinct_patterns(t):
    w = patterns(t)
    body = F.struct(*[c for c in w.columns if c not in ("project_id", "service_id", "pattern")])
    first = w.groupBy("project_id", "service_id", "pattern").agg(F.min_by(body, "arrival").alias("_b"))
    return first.select("project_id", "service_id", "pattern", "_b.*")


# Ratios of each pattern and the earlier ones of its project and service scope.
NEAR = (
    """WITH RECURSIVE pt AS (SELECT 1 + p_partkey % 5 AS project_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 8 END AS service_id,
    p_name || ' ' || lower(p_brand) || ' ' || lower(p_type) AS pattern, p_partkey AS id, 1 + p_partkey % 3 AS n FROM part
    QUALIFY row_number() OVER (PARTITION BY project_id, service_id, pattern ORDER BY id) = 1),
pr AS (SELECT x.project_id, x.id AS l, y.id AS r, x.pattern AS a, y.pattern AS b FROM pt x JOIN pt y ON y.project_id = x.project_id AND y.id < x.id
    AND (x.service_id IS NULL OR y.service_id IS NULL OR x.service_id = y.service_id)),
"""
    + Q.ratios("pr")
    + ", sc AS (SELECT pr.*, ratio FROM pr JOIN ratio USING (a, b) WHERE ratio >= 0.75)"
)


@query(
    "j12_x32_x33_similar_groups",
    NEAR
    + """ SELECT project_id, l AS l_id, r AS r_id, round(ratio, 6) AS score, CASE WHEN ratio >= 0.92 THEN 'HIGH_CONFIDENCE' ELSE 'POSSIBLE_MATCH' END AS classification
    FROM sc QUALIFY row_number() OVER (PARTITION BY project_id, l ORDER BY ratio DESC, r) = 1""",
)
def j12(t):
    p = distinct_patterns(t)
    best = G.best_matches(p, p, earlier_only=True)
    return best.selectExpr("project_id", "l_id", "r_id", "round(score, 6) as score", "classification")


@query(
    "a2_merge_similar",
    NEAR
    + """, ranked AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS place,
      (SELECT list(r) FROM sc WHERE sc.l = pt.id AND ratio >= 0.92) AS close FROM pt),
    walk AS (SELECT DISTINCT project_id, 0 AS place, [0]::BIGINT[] AS stands FROM pt
      UNION ALL SELECT k.project_id, k.place, CASE WHEN close IS NOT NULL AND list_has_any(close, stands) THEN stands ELSE list_append(stands, k.id) END
      FROM walk w JOIN ranked k ON k.project_id = w.project_id AND k.place = w.place + 1),
    lead AS (SELECT unnest(arg_max(stands, place)[2:]) AS id FROM walk GROUP BY project_id),
    best AS (SELECT l, r, ratio FROM sc WHERE r IN (SELECT id FROM lead) QUALIFY row_number() OVER (PARTITION BY l ORDER BY ratio DESC, r) = 1),
    own AS (SELECT pt.*, CASE WHEN lead.id IS NULL THEN best.r ELSE pt.id END AS owner, lead.id IS NOT NULL AS leads, best.r, ratio
      FROM pt LEFT JOIN lead ON lead.id = pt.id LEFT JOIN best ON best.l = pt.id)
    SELECT project_id, owner AS id, max(pattern) FILTER (WHERE leads) AS pattern, 'HIGH' AS severity, arg_min(service_id, id) FILTER (WHERE service_id IS NOT NULL) AS service_id,
      CAST(sum(n) AS BIGINT) AS occurrence_count, count(*) AS members, max(r) FILTER (WHERE leads) AS candidate, round(max(ratio) FILTER (WHERE leads), 6) AS candidate_score
    FROM own GROUP BY project_id, owner""",
)
def a2(t):
    merged, candidates = G.merge_similar(distinct_patterns(t))
    n = candidates.groupBy("project_id", F.col("source_group_id").alias("id")).agg(
        F.max("candidate_group_id").alias("candidate"), F.round(F.max("score"), 6).alias("candidate_score")
    )
    return merged.join(n, ["project_id", "id"], "left").drop("first_seen", "last_seen")


@query(
    "x33_sequence_ratio",
    "WITH RECURSIVE p AS (SELECT p_partkey, p_brand, p_name || ' ' || p_type AS text FROM part), "
    "f AS (SELECT p_brand, arg_min(text, p_partkey) AS first_text FROM p GROUP BY 1), "
    "q AS (SELECT p_partkey, text AS a, first_text AS b FROM p JOIN f USING (p_brand)), "
    + Q.ratios("q")
    + " SELECT p_partkey, round(ratio, 6) AS ratio FROM q JOIN ratio USING (a, b)",
)
def x33(t):
    """Each part name against its brand-mates' first name."""
    p = t.table("part").selectExpr("p_partkey", "p_brand", "concat(p_name, ' ', p_type) as text")
    first = p.groupBy("p_brand").agg(F.min_by("text", "p_partkey").alias("first_text"))
    pairs = p.join(first, "p_brand")
    return pairs.select("p_partkey", F.round(S.seq_ratio("text", "first_text"), 6).alias("ratio"))


@query(
    "x32_classify_similarity",
    """SELECT event_id, CASE WHEN value / 400 >= 0.92 THEN 'HIGH_CONFIDENCE' WHEN value / 400 >= 0.75 THEN 'POSSIBLE_MATCH'
    ELSE 'NO_MATCH' END AS class FROM events""",
)
def x32(t):
    from faultline.functions.scores import classify_similarity

    return t.table("events").select("event_id", classify_similarity(F.col("value") / 400).alias("class"))
