"""Scans, payload flatteners, ingestion and streaming queries.

Input texts are derived from the tables by Spark, so every query reads a
whole table; the file readers are covered by the tests.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import query
from catalog import roles_sql as Q
from catalog.roles import NOW
from faultline.functions import fields as X
from faultline.session import cut, shared_path
from faultline.sources import events as EVT
from faultline.sources import logs as L
from faultline.sources import payloads as PL

TS = "date_format(at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
LEVEL_RE = "'\\b(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRITICAL|FATAL)\\b'"


def _us():
    return F.unix_micros("timestamp").alias("us")



@query(
    "s1_x6_scan_plain",
    Q.cte(Q.LINES)
    + f""" SELECT doc_id, line_number, CASE WHEN doc_id % 3 > 0 THEN us END AS us,
      {Q.severity(f"CASE WHEN doc_id % 3 > 0 THEN level ELSE regexp_extract(line, {LEVEL_RE}, 1, 'i') END")} AS severity,
      CASE WHEN doc_id % 3 > 0 THEN 'app ' || trim(line) ELSE trim(line) END AS message FROM lines""",
)
def s1(t):
    line = F.expr(f"case when doc_id % 3 > 0 then concat({TS}, ' ', level, ' app ', trim(line)) else line end")
    p = L.parse_plain(t.lines.withColumn("line", line))
    return p.select("doc_id", "line_number", _us(), "severity", "message")


@query(
    "s2_x7_scan_key_value",
    Q.cte(Q.EV)
    + """ SELECT id, us - us % 1000000 AS us, CASE WHEN severity = 'HIGH' THEN 'HIGH' ELSE 'LOW' END AS severity, 'svc' || (user_id % 5) AS service,
      CASE WHEN id % 2 = 0 THEN message ELSE 'slow call took' END AS message, 'b' || k AS request_id FROM ev""",
)
def s2(t):
    line = F.expr(
        """concat("time=", date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), " level=", if(severity = 'HIGH', 'error', 'low'), " app=svc", user_id % 5,
        " request_id=a", k, if(id % 2 = 0, concat(" msg='", message, "'"), " slow call took"), ' req_id="x y" request_id=b', k)"""
    )
    e = t.events.withColumn("severity", F.coalesce("severity", F.lit("LOW")))
    p = L.parse_kv(e.select("id", line.alias("line")))
    return p.select("id", _us(), "severity", "service", "message", "request_id")


@query(
    "s4_x1_scan_jsonl",
    Q.cte(Q.EV)
    + """ SELECT id, id % 10 = 7 AS corrupt, CASE WHEN id % 10 = 7 OR id % 10 = 4 THEN NULL WHEN id % 2 = 0 THEN us // 1000 * 1000 ELSE us END AS us,
      CASE WHEN id % 10 <> 7 THEN message END AS message, CASE WHEN id % 10 <> 7 THEN 's' || k END AS service FROM ev""",
)
def s4(t):
    stamp = """case when id % 10 = 4 then '"12345"' when id % 2 = 0 then cast(unix_millis(timestamp) as string)
      else concat('"', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), '"') end"""
    line = F.expr(
        f"""if(id % 10 = 7, 'not json', concat('{{"@timestamp": ', {stamp}, ', "msg": "', message, '", "Application": "s', k, '", "n": {{"a": 1}}}}'))"""
    )
    p = L.parse_jsonl(t.events.select("id", line.alias("line")))
    return p.select("id", "corrupt", _us(), "message", "service")


@query(
    "s3_scan_json_documents",
    Q.cte(Q.LINES)
    + """ SELECT doc_id, CASE WHEN doc_id % 9 = 5 THEN 1 ELSE CAST(n AS BIGINT) END AS line_number, CASE WHEN doc_id % 9 = 5 THEN 'one' ELSE line END AS message
    FROM lines0 WHERE doc_id % 9 <> 5 OR n = 1""",
)
def s3(t):
    items = "transform(split(text, '\\n'), x -> named_struct('message', x))"
    doc = F.expr(f"if(doc_id % 9 = 5, '{{\"message\": \"one\"}}', to_json({items}))")
    p = L.parse_json(t.table("documents").select("doc_id", doc.alias("line")))
    # An empty message counts as absent.
    return p.select("doc_id", "line_number", F.coalesce("message", F.lit("")).alias("message"))


@query(
    "s5_scan_csv",
    """SELECT c_custkey AS id, c_name AS message, CASE WHEN c_custkey % 2 = 0 THEN 'HIGH' END AS severity, lower(c_mktsegment) AS service FROM customer WHERE c_custkey % 8 <> 3""",
)
def s5(t):
    folder = shared_path(t.spark, "csv")
    rows = t.table("customer").selectExpr(
        "if(c_custkey % 8 = 3, ' ', cast(c_custkey as string)) as `x-request-id`",
        "if(c_custkey % 8 = 3, ' ', c_name) as Message",
        "if(c_custkey % 8 = 3, null, if(c_custkey % 2 = 0, 'err', 'medium')) as lvl",
        "if(c_custkey % 8 = 3, null, lower(c_mktsegment)) as component",
    )
    rows.write.option("header", True).csv(folder)
    p = L.scan_csv(t.spark, folder)
    return p.select(F.col("request_id").cast("bigint").alias("id"), "message", "severity", "service")


def _files(t, name: str, least: int) -> int:
    """How many files to write of what comes from a table: one a split of it, but ``least`` for a small one."""
    return max(least, t.table(name).rdd.getNumPartitions())


def _written(t, lines, name: str) -> str:
    """A folder of text files, 16 of them or one a split of the table."""
    folder = shared_path(t.spark, "lines")
    lines.select(lines.columns[0]).repartition(_files(t, name, 16)).write.text(folder)
    return folder


@query(
    "s1_scan_plain_files",
    Q.cte(Q.LINES) + f""" SELECT us, {Q.severity('level')} AS severity, 'doc ' || doc_id || ' ' || trim(line) AS message FROM lines""",
)
def s1_files(t):
    line = F.expr(f"concat({TS}, ' ', level, ' doc ', doc_id, ' ', trim(line))")
    return L.scan_plain(t.spark, _written(t, t.lines.select(line.alias("line")), "documents")).select(_us(), "severity", "message")


@query(
    "s2_scan_key_value_files",
    Q.cte(Q.EV) + " SELECT us - us % 1000000 AS us, 'svc' || (user_id % 5) AS service, message, 'r' || id AS request_id FROM ev WHERE message IS NOT NULL",
)
def s2_files(t):
    line = F.expr(
        """concat("time=", date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), " app=svc", user_id % 5, " msg='", message, "' request_id=r", id)"""
    )
    e = t.events.where("message is not null").select(line.alias("line"))
    return L.scan_kv(t.spark, _written(t, e, "events")).select(_us(), "service", "message", "request_id")


@query(
    "s4_scan_jsonl_files",
    Q.cte(Q.EV)
    + """ SELECT id % 10 = 7 AS corrupt, CASE WHEN id % 10 <> 7 THEN us END AS us, CASE WHEN id % 10 <> 7 THEN message END AS message,
      CASE WHEN id % 10 <> 7 THEN 's' || k END AS service FROM ev""",
)
def s4_files(t):
    stamp = "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    line = F.expr(f"if(id % 10 = 7, 'not json', to_json(named_struct('@timestamp', {stamp}, 'msg', message, 'Application', concat('s', k))))")
    return L.scan_jsonl(t.spark, _written(t, t.events.select(line.alias("line")), "events")).select("corrupt", _us(), "message", "service")


@query(
    "s5_scan_csv_documents",
    "SELECT doc_id, md5(text) AS digest, source AS service FROM documents WHERE text <> ''",
)
def s5_documents(t):
    """Texts with line breaks, commas and quotes as cells, in few files of many blocks."""
    folder = shared_path(t.spark, "csv")
    d = t.table("documents").selectExpr("cast(doc_id as string) as request_id", "text as message", "source as service")
    d.coalesce(_files(t, "documents", 2)).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    p = L.scan_csv(t.spark, folder).where("message is not null")
    return p.select(F.col("request_id").cast("bigint").alias("doc_id"), F.md5("message").alias("digest"), "service")


@query(
    "s6_detect_formats",
    r"""WITH s AS (SELECT doc_id, list_filter(list_slice(string_split(text, chr(10)), 1, 8), lambda x: trim(x) <> '') AS l FROM documents)
    SELECT 'doc' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.jsonl' WHEN 4 THEN '.log' ELSE '' END AS file,
      CASE WHEN doc_id % 6 = 0 THEN 'csv' WHEN doc_id % 6 = 1 THEN 'jsonl' WHEN doc_id % 6 = 2 THEN CASE WHEN len(l) = 1 THEN 'json' ELSE 'jsonl' END
        WHEN len(l) >= 2 AND contains(CASE WHEN doc_id % 6 = 3 THEN 'n=1 ' ELSE '' END || l[1], ',') AND len(list_filter(
          string_split(CASE WHEN doc_id % 6 = 3 THEN 'n=1 ' ELSE '' END || l[1], ','), lambda c: regexp_full_match(trim(c), '[\p{L}_][\p{L}\p{N}_]*') OR contains(c, '_'))) > 0 THEN 'csv'
        WHEN len(l) > 0 AND (doc_id % 6 = 3 OR len(list_filter(l, lambda x: contains(x, '='))) >= greatest(1, len(l) // 2)) THEN 'structured_text' ELSE 'plain_text' END AS format FROM s""",
)
def s6(t):
    lines = """transform(slice(split(text, '\\n'), 1, 8), x -> case when trim(x) = '' then x when doc_id % 6 = 2 then to_json(named_struct('m', x))
      when doc_id % 6 = 3 then concat('n=1 ', x) else x end)"""
    name = "concat('doc', doc_id, case doc_id % 6 when 0 then '.csv' when 1 then '.jsonl' when 4 then '.log' else '' end)"
    d = t.table("documents").selectExpr(f"{name} as file", f"{lines} as lines")
    return L.detect_samples(d).select("file", "format")


@query(
    "s7_s8_parse_stats",
    Q.cte(Q.LINES)
    + """ SELECT file, 'plain_text' AS format, count(*) AS records_parsed, 0 AS records_skipped FROM lines GROUP BY 1
    UNION ALL SELECT 'events', 'jsonl', count(*) FILTER (WHERE event_id % 10 <> 7), count(*) FILTER (WHERE event_id % 10 = 7) FROM events""",
)
def s8(t):
    js = t.table("events").selectExpr("'events' as file", "if(event_id % 10 = 7, '[1]', concat('{\"msg\": ', event_id, '}')) as line")
    both = L.parse_plain(t.lines.select("file", "line_number", "line")).unionByName(L.parse_jsonl(js))
    return L.parse_stats(both)


def event_json(t):
    kind = "if(id % 20 = 3, 'OTHER', event_type)"
    body = f"""named_struct('event_type', {kind}, 'timestamp', if(id % 20 = 4, 'soon', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:00'")),
      'source', if(id % 20 = 5, '', source), 'source_type', 'demo', 'service', case when id % 7 = 0 then 'nation_99' when id % 7 < 4 then concat('nation_', user_id % 25) end,
      'raw_data', if(id % 20 = 6, null, map('k', k)), 'message', if(event_type = 'LOG' and id % 20 <> 8, message, null), 'severity', if(event_type = 'LOG', severity, null), 'metric_name', metric_name,
      'value', value, 'name', if(event_type = 'ALERT', message, null), 'status', status, 'trace_id', if(event_type = 'TRACE' and id % 20 <> 9, trace_id, null), 'span_id', span_id,
      'duration_ms', if(event_type = 'TRACE', v - 5, null), 'version', version, 'extra', if(id % 20 = 7, 1, null))"""
    return t.events.selectExpr("id as index", "project_id + if(id % 50 = 0, 10, 0) as project_id", "id div 1000 as batch", f"to_json({body}) as payload")


EVJ = """ej AS (SELECT *, CASE WHEN id % 20 IN (3, 4, 5, 6, 7) OR (event_type = 'LOG' AND id % 20 = 8) OR (event_type = 'TRACE' AND (id % 20 = 9 OR v < 5)) THEN 'VALIDATION_ERROR' END AS bad,
  project_id + CASE WHEN id % 50 = 0 THEN 10 ELSE 0 END AS pid, CASE WHEN id % 7 = 0 THEN 'nation_99' WHEN id % 7 < 4 THEN 'nation_' || (user_id % 25) END AS sname FROM ev),
oc AS (SELECT ej.*, svc.id AS sid, CASE WHEN bad IS NOT NULL THEN bad WHEN prj.id IS NULL THEN 'PROJECT_NOT_FOUND' WHEN sname IS NOT NULL AND svc.id IS NULL THEN 'SERVICE_NOT_FOUND'
  ELSE 'ACCEPTED' END AS status2 FROM ej LEFT JOIN prj ON prj.id = pid LEFT JOIN svc ON svc.project_id = pid AND svc.name = sname)"""


@query("s9_parse_events", Q.cte(Q.EV, Q.PRJ, Q.SVC, EVJ) + " SELECT id AS index, us - 3600000000 AS us, event_type FROM oc WHERE bad IS NULL")
def s9(t):
    accepted, _ = EVT.parse_events(event_json(t))
    return accepted.select("index", _us(), "event_type")


@query("s9_event_rejects", Q.cte(Q.EV, Q.PRJ, Q.SVC, EVJ) + " SELECT id AS index FROM oc WHERE bad IS NOT NULL")
def s9b(t):
    _, rejects = EVT.parse_events(event_json(t))
    return rejects.select("index")


@query(
    "s17_j1_j2_ingest_outcomes",
    Q.cte(Q.EV, Q.PRJ, Q.SVC, EVJ) + " SELECT id AS index, pid AS project_id, status2 AS status, CASE WHEN status2 = 'ACCEPTED' THEN sid END AS service_id FROM oc",
)
def s17(t):
    _, outcomes = EVT.ingest(EVT.checked_events(event_json(t)), t.projects, t.services)
    return outcomes.select("index", "project_id", "status", "service_id")


@query(
    "s17_write_events",
    Q.cte(Q.EV, Q.PRJ, Q.SVC, EVJ)
    + """ SELECT pid AS project_id, CAST(make_timestamp(us - 3600000000) AS DATE) AS event_date, event_type, count(*) AS n, count(*) AS ids
    FROM oc WHERE status2 = 'ACCEPTED' GROUP BY ALL""",
)
def s17_write(t):
    """Two writes, the first one tried again with other rows; then the table is read back."""
    accepted, _ = EVT.ingest(EVT.checked_events(event_json(t)), t.projects, t.services)
    accepted, path = cut(accepted), shared_path(t.spark, "events")
    early = F.col("index") < accepted.agg(F.avg("index")).first()[0]
    EVT.write_events(accepted.where(early), path, "batch-1")
    EVT.write_events(accepted.where(~early), path, "batch-2")
    EVT.write_events(accepted, path, "batch-1")
    rows = EVT.read_events(t.spark, path)
    return rows.groupBy("project_id", "event_date", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query(
    "a13_batch_totals",
    Q.cte(Q.EV, Q.PRJ, Q.SVC, EVJ)
    + """ SELECT pid AS project_id, id // 1000 AS batch, count(*) AS total, count(*) FILTER (WHERE status2 = 'ACCEPTED') AS accepted,
    count(*) FILTER (WHERE status2 <> 'ACCEPTED') AS rejected FROM oc GROUP BY 1, 2""",
)
def a13b(t):
    _, outcomes = EVT.ingest(EVT.checked_events(event_json(t)), t.projects, t.services)
    return EVT.batch_totals(outcomes)


@query(
    "s10_flatten_metric_payload",
    Q.cte(Q.EV)
    + """, m AS (SELECT * FROM ev WHERE event_type = 'METRIC')
    SELECT CASE WHEN id % 4 = 2 THEN 'q' || id WHEN id % 5 = 0 THEN 'unknown_metric' ELSE metric_name END AS metric_name, (us // 1000 + d * 1000) * 1000 AS us, round(v + d, 2) AS value,
      CASE WHEN id % 4 <> 2 THEN 'h' || k END AS host FROM m, range(2) r(d) WHERE id % 4 < 3 AND (d = 0 OR id % 4 = 1)""",
)
def s10(t):
    metric = "if(id % 5 = 0, map('host', concat('h', k)), map('__name__', metric_name, 'host', concat('h', k)))"
    one = "array(string(unix_millis(timestamp) / 1000D), string(v))"
    two = "array(string(unix_millis(timestamp) / 1000D + 1), string(v + 1))"
    data = f"""case id % 4 when 0 then to_json(named_struct('status', 'success', 'data', named_struct('resultType', 'vector', 'result', array(named_struct('metric', {metric}, 'value', {one})))))
      when 1 then to_json(named_struct('status', 'success', 'data', named_struct('resultType', 'matrix', 'result', array(named_struct('metric', {metric}, 'values', array({one}, {two}))))))
      when 2 then to_json(named_struct('status', 'success', 'data', named_struct('resultType', 'scalar', 'result', {one})))
      else '{{"status": "error", "errorType": "bad_data", "error": "no"}}' end"""
    p = t.events.filter("event_type = 'METRIC'").selectExpr("concat('q', id) as query", f"{data} as payload")
    rows, _ = PL.flatten_metric_payload(p, "metrics")
    return rows.select("metric_name", _us(), F.round("value", 2).alias("value"), F.try_element_at("labels", F.lit("host")).alias("host"))


@query(
    "s11_flatten_search_hits",
    Q.cte(Q.EV)
    + """ SELECT 'x' || id AS source_id, us, message, CASE WHEN id % 2 = 0 THEN 's' || k ELSE 'fallback' END AS service, CASE severity WHEN 'HIGH' THEN 'HIGH' END AS severity
    FROM ev WHERE id % 9 NOT IN (1, 2, 3)""",
)
def s11(t):
    src = """named_struct('@timestamp', if(id % 9 = 2, 'never', date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), 'message', if(id % 9 = 1, '  ', concat(' ', message)),
      'service', if(id % 2 = 0, concat('s', k), ''), 'severity', if(severity = 'HIGH', 'err', 'odd'))"""
    hit = f"named_struct('_index', 'logs', '_id', concat('x', id), '_source', if(id % 9 = 3, null, {src}))"
    p = t.events.selectExpr(f"to_json(named_struct('hits', named_struct('hits', array({hit})))) as payload")
    got = PL.flatten_search_hits(p, PL.LogFields(default_service="fallback"), "search")
    return got.select("source_id", _us(), "message", "service", "severity")


@query(
    "s12_rows_to_log_events",
    Q.cte(Q.EV) + " SELECT CAST(id AS VARCHAR) AS source_id, us, message, coalesce(trace_id, 'none') AS trace_id FROM ev",
)
def s12(t):
    got = PL.rows_to_log_events(t.events, PL.LogFields(timestamp="timestamp"), "table")
    return got.select("source_id", _us(), "message", F.coalesce("trace_id", F.lit("none")).alias("trace_id"))


ISO = "date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


@query(
    "s13_a14_codehost_deployments",
    Q.cte(Q.EV)
    + """, d AS (SELECT *, us - us % 1000000 AS u FROM ev WHERE event_type = 'DEPLOYMENT')
    SELECT CAST(id AS VARCHAR) AS source_id, u AS us, 'v' || k AS version, 'sha' || id AS commit_sha, 'prod' AS environment, CASE WHEN id % 2 = 0 THEN 'a.py,b.py' ELSE '' END AS files FROM d WHERE id % 7 <> 1
    UNION ALL SELECT CAST(id AS VARCHAR), u, 'tag' || k, 'main', NULL, '' FROM d WHERE id % 3 <> 0""",
)
def s13(t):
    d = t.events.filter("event_type = 'DEPLOYMENT'")
    dep = d.selectExpr(
        "'org/app' as repository",
        f"""to_json(array(named_struct('id', id, 'sha', if(id % 7 = 1, null, concat('sha', id)), 'ref', concat('v', k), 'environment', 'prod', 'created_at', {ISO},
        'creator', named_struct('login', 'dev')))) as payload""",
    )
    rel = d.selectExpr(
        "'org/app' as repository",
        f"to_json(array(named_struct('id', id, 'tag_name', concat('tag', k), 'target_commitish', 'main', 'published_at', if(id % 3 = 0, null, {ISO})))) as payload",
    )
    files = PL.commit_files(
        d.filter("id % 2 = 0").selectExpr("concat('sha', id) as sha", """'[{"filename": "a.py", "additions": 3}, {"status": "x"}, {"filename": "b.py"}]' as payload""")
    )
    feed = PL.deployments_from_codehost(dep, rel, "codehost", files)
    return feed.select("source_id", _us(), "version", "commit_sha", "environment", F.array_join("changed_files", ",").alias("files"))


@query(
    "s14_ci_deployments",
    Q.cte(Q.EV)
    + """, d AS (SELECT *, us - us % 1000000 AS u FROM ev WHERE event_type = 'DEPLOYMENT')
    SELECT CAST(id AS VARCHAR) AS source_id, CASE WHEN id % 2 = 0 THEN u ELSE u - 60000000 END AS us, 'build ' || id AS version, 'dev' AS author, NULL AS environment FROM d WHERE id % 3 <> 0
    UNION ALL SELECT CAST(id AS VARCHAR), u, 'rel ' || id, NULL, NULL FROM d
    UNION ALL SELECT CAST(id AS VARCHAR), u, 'r' || k, 'ops', 'prod' FROM d WHERE id % 4 <> 1""",
)
def s14(t):
    d = t.events.filter("event_type = 'DEPLOYMENT'")
    early = "date_format(timestamp - interval 60 seconds, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"

    def wrapped(item: str):
        return d.selectExpr("'app' as repository", f"to_json(named_struct('count', 1, 'value', array({item}))) as payload")

    b = wrapped(
        f"""named_struct('id', id, 'buildNumber', concat('build ', id), 'result', case id % 3 when 0 then 'failed' when 1 then 'succeeded' end, 'queueTime', {early},
        'finishTime', if(id % 2 = 0, {ISO}, null), 'requestedBy', named_struct('displayName', '', 'uniqueName', 'dev'))"""
    )
    r = wrapped(f"named_struct('id', id, 'name', concat('rel ', id), 'createdOn', {ISO})")
    x = wrapped(
        f"""named_struct('id', id, 'deploymentStatus', if(id % 4 = 1, 'failed', 'partiallySucceeded'), 'startedOn', {early}, 'completedOn', {ISO},
        'release', named_struct('id', 1, 'name', concat('r', k)), 'releaseEnvironment', named_struct('name', 'prod'), 'requestedFor', named_struct('displayName', 'ops'))"""
    )
    feed = PL.deployments_from_ci(b, r, x, "ci")
    return feed.select("source_id", _us(), "version", "author", "environment")


@query(
    "s15_commits_and_pull_requests",
    Q.cte(Q.EV)
    + """, d AS (SELECT *, us - us % 1000000 AS u FROM ev WHERE event_type = 'DEPLOYMENT')
    SELECT 'commit' AS kind, 'sha' || id AS key, message AS title, u AS us FROM d WHERE id % 5 <> 0
    UNION ALL SELECT 'ci', 'c' || id, message, CASE WHEN id % 2 = 0 THEN u END FROM d
    UNION ALL SELECT 'pr', CAST(id AS VARCHAR), message, u FROM d WHERE id % 3 <> 0""",
)
def s15(t):
    d = t.events.filter("event_type = 'DEPLOYMENT'")

    def page(item: str):
        return d.selectExpr("'app' as repository", f"to_json(array({item})) as payload")

    c = PL.flatten_commits(page(f"named_struct('sha', concat('sha', id), 'commit', named_struct('message', message, 'author', named_struct('name', 'd', 'date', if(id % 2 = 0 and id % 5 > 0, {ISO}, null)), 'committer', named_struct('date', if(id % 5 = 0, null, {ISO}))))"))
    ci = PL.flatten_commits(page(f"named_struct('commitId', concat('c', id), 'comment', message, 'author', named_struct('date', if(id % 2 = 0, {ISO}, null)))"))
    pr = PL.flatten_pull_requests(page(f"named_struct('number', id, 'title', message, 'state', 'open', 'created_at', if(id % 3 = 0, null, {ISO}))"))
    us = F.unix_micros("committed_at").alias("us")
    out = c.select(F.lit("commit").alias("kind"), F.col("sha").alias("key"), F.col("message").alias("title"), us)
    out = out.unionByName(ci.select(F.lit("ci").alias("kind"), F.col("sha").alias("key"), F.col("message").alias("title"), us))
    return out.unionByName(
        pr.select(F.lit("pr").alias("kind"), F.col("number").cast("string").alias("key"), "title", F.unix_micros("created_at").alias("us"))
    )


def webhooks(t):
    a = t.events.filter("event_type = 'ALERT'")
    alert = f"""named_struct('status', if(id % 9 = 4, 'odd', lower(status)), 'labels', map('alertname', if(id % 9 = 5, '', message), 'service', concat('s', k)),
      'startsAt', if(id % 5 = 0, '0001-01-01T00:00:00Z', {ISO}), 'endsAt', if(status = 'RESOLVED', {ISO}, ''), 'fingerprint', concat('f', id))"""
    return a.selectExpr(
        "id as payload_id",
        f"to_json(named_struct('receiver', 'ops', 'commonLabels', map('service', 'common', 'severity', 'critical', 'env', 'qa'), 'alerts', array({alert}))) as payload",
    )


@query(
    "s16_explode_alerts",
    Q.cte(Q.EV)
    + f""" SELECT id AS payload_id, message AS title, status, 's' || k AS service, 'qa' AS environment, 'CRITICAL' AS severity,
      CASE WHEN id % 5 = 0 AND status = 'FIRING' THEN {Q.NOW_US} ELSE us - us % 1000000 END AS us FROM ev WHERE event_type = 'ALERT' AND id % 9 NOT IN (4, 5)""",
)
def s16(t):
    events, _ = PL.explode_alerts(webhooks(t), NOW)
    return events.select("payload_id", "title", "status", "service", "environment", "severity", _us())


@query(
    "s18_records_to_events",
    Q.cte(Q.LINES, Q.REC) + " SELECT doc_id, line_number, 'LOG' AS event_type, 'disk' AS source, 'file' AS source_type, message FROM rec",
)
def s18(t):
    from faultline.operators.normalize import records_to_events

    return records_to_events(t.records, "disk").select("doc_id", "line_number", "event_type", "source", "source_type", "message")


@query(
    "s19_canonical_json",
    """SELECT c_custkey AS id, '{"a":{"b":' || CAST(to_json(c_name) AS VARCHAR) || ',"z":null},"k":' || c_custkey || ',"l":["x",' || CAST(to_json(c_mktsegment) AS VARCHAR) || ']}' AS json FROM customer""",
)
def s19(t):
    rows = t.table("customer").selectExpr(
        "c_custkey as k", "array('x', c_mktsegment) as l", "named_struct('z', cast(null as string), 'b', c_name) as a"
    )
    j = EVT.to_canonical_json(rows)
    return j.select(F.get_json_object("json", "$.k").cast("bigint").alias("id"), "json")


def _arrive(t, df, at: str, job, parts: int = 3, write=None, held: bool = False):
    """The table of a stream that ``df`` reaches in ``parts`` spans of time, several files each, read at once.

    ``held`` says that ``df`` is written already. The stream ends after each arrival and goes on from its checkpoint at the next.
    A last row, without anything but a time two days on, moves the clock past all others.
    """
    folder, out, state = (shared_path(t.spark, x) for x in ("input", "out", "stream"))
    df = df if held else cut(df)
    files = max(4, df.rdd.getNumPartitions())
    us = F.unix_micros(at)
    bounds = df.select(us.cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.01)
    span = sum((F.when(us >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    end = df.agg(F.max(at)).first()[0]
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != at]
    clock = t.spark.range(1).select(*null, (F.lit(end) + F.expr("interval 2 days")).alias(at)).select(*df.columns)
    for rows in [*[df.where(span == k).repartition(files) for k in range(parts)], clock]:
        rows.write.mode("append").parquet(folder)
        stream = job(t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(64, files)).parquet(folder))
        writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
        writer = writer.foreachBatch(write(out)).outputMode("update") if write else writer.format("parquet").option("path", out)
        writer.start().awaitTermination()
    return out if write else t.spark.read.schema(stream.schema).parquet(out)


@query(
    "t3_stream_error_groups",
    Q.cte(Q.LINES, Q.REC)
    + """ SELECT project_id, severity, service, pattern AS normalized_message, count(*) AS n FROM rec WHERE pattern IS NOT NULL GROUP BY ALL""",
)
def t3(t):
    from faultline.operators.groups import with_fingerprint
    from faultline.streaming import jobs

    records = cut(t.records.select("project_id", "severity", "service", "normalized_message", "timestamp"))
    path = _arrive(t, records, "timestamp", jobs.stream_error_groups, write=jobs.merge_updates, held=True)
    g = jobs.latest_updates(t.spark, path, ["project_id", "fingerprint"])
    keyed = with_fingerprint(records.select("project_id", "severity", "service", "normalized_message").distinct())
    return keyed.join(g.select("project_id", "fingerprint", F.col("occurrence_count").alias("n")), ["project_id", "fingerprint"]).drop("fingerprint")


@query(
    "t3_stream_error_windows",
    Q.cte(Q.LINES, Q.REC)
    + """ SELECT project_id, us // 86400000000 * 86400000000 AS start_us, count(*) AS n, count(DISTINCT (severity, service, pattern)) AS groups
    FROM rec WHERE pattern IS NOT NULL GROUP BY ALL""",
)
def t3_windows(t):
    from faultline.streaming import jobs

    records = t.records.select("project_id", "severity", "service", "normalized_message", "timestamp")
    w = _arrive(t, records, "timestamp", lambda s: jobs.stream_error_windows(s, width="1 day"))
    return w.groupBy("project_id", F.unix_micros("start").alias("start_us")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))


@query(
    "t2_stream_dedupe",
    Q.cte(Q.LINES, Q.REC) + f", f AS (SELECT {Q.fingerprint(Q._q('LOG'), 'pattern', 'service', 'severity', Q._q(''))} AS fingerprint FROM rec) SELECT DISTINCT fingerprint FROM f",
)
def t2(t):
    """With a state that forgets after an hour a fingerprint may pass again; the list of those that passed is compared."""
    from faultline.streaming import jobs

    records = t.records.select("timestamp", "severity", "service", "normalized_message")
    passed = _arrive(t, records, "timestamp", lambda s: jobs.stream_dedupe(s, "1 hour").select("fingerprint", "timestamp"))
    return passed.where(F.col("timestamp") <= F.lit(records.agg(F.max("timestamp")).first()[0])).select("fingerprint").distinct()


def _alerts(t):
    from catalog.incidents_q import alerts

    return alerts(t)


def _alerts_sql(columns: str) -> str:
    from catalog.incidents_q import ALERTS

    return Q.cte(ALERTS) + f" SELECT {columns} FROM outc"


@query("t4_stream_incidents", _alerts_sql("project_id, seq, action, episode"))
def t4(t):
    from faultline.streaming import jobs

    s = _arrive(t, _alerts(t), "timestamp", lambda s: jobs.stream_incidents(s, bucket="1 day"))
    return s.select("project_id", "seq", "action", "episode")


@query(
    "t5_stream_anomalies",
    Q.cte("pts AS (SELECT event_type AS metric_name, epoch_us(ts) AS us, event_id AS id, value FROM events)", Q.rolling("pts", "metric_name"))
    + """ SELECT metric_name, id, concat_ws(',', CASE WHEN abs(z) >= 2.5 THEN 'z_score' END, CASE WHEN abs(pct) >= 50 THEN 'percentage_change' END,
      CASE WHEN pr <= 5 OR pr >= 95 THEN 'percentile' END) AS signals FROM roll WHERE n >= 4 AND (coalesce(abs(z) >= 2.5, false) OR coalesce(abs(pct) >= 50, false) OR pr <= 5 OR pr >= 95)""",
)
def t5(t):
    from faultline.streaming import jobs

    m = t.table("events").selectExpr("event_type as metric_name", "cast(ts as timestamp) as timestamp", "event_id as id", "value")
    found = _arrive(t, m, "timestamp", lambda s: jobs.stream_anomalies(s, bucket="6 hours"))
    return found.select("metric_name", "id", F.array_join("signals", ",").alias("signals"))


@query(
    "t1_stream_ingest",
    Q.cte(Q.LINES) + f" SELECT file, count(*) AS n, count(DISTINCT {Q.pattern('line')}) AS patterns FROM lines GROUP BY 1",
)
def t1(t):
    from faultline.streaming import jobs

    folder, out = shared_path(t.spark, "logs"), shared_path(t.spark, "out")
    js = t.lines.selectExpr("to_json(named_struct('host', file, 'msg', line, 'ts', date_format(at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))) as value")
    js.repartition(_files(t, "documents", 4)).write.text(folder)
    writer = jobs.stream_ingest(jobs.stream_records(t.spark, folder), out, shared_path(t.spark, "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(out)
    return rows.groupBy(F.col("host").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("normalized_message").alias("patterns")
    )


@query(
    "s7_scan_logs",
    Q.cte(Q.LINES)
    + """ SELECT 'jsonl' AS format, count(*) AS n FROM lines UNION ALL SELECT 'plain_text', count(*) FROM benchmark, (SELECT unnest(string_split(text, chr(10))) AS l)
      WHERE trim(l) <> ''""",
)
def s7(t):
    folder = shared_path(t.spark, "mixed")
    t.lines.selectExpr("to_json(named_struct('msg', line, 'service', source)) as value").repartition(_files(t, "documents", 4)).write.text(f"{folder}/a")
    words = t.table("benchmark").selectExpr("explode(split(replace(text, ',', ';'), '\\n')) as value")  # no file looks like CSV
    words.repartition(_files(t, "benchmark", 2)).write.text(f"{folder}/b")
    return L.scan_logs(t.spark, [f"{folder}/a", f"{folder}/b"]).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s20_evidence_sink",
    """WITH o AS (SELECT *, o_custkey % 3 > 0 AND bool_or(o_orderkey % 2 = 0) OVER (PARTITION BY o_custkey) AS late FROM orders)
    SELECT o_custkey AS incident_id, count(*) AS items, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(late AS INT) AS build FROM o
    WHERE NOT late OR o_orderkey % 2 = 0 GROUP BY o_custkey, late""",
)
def s20(t):
    """A build of all incidents, a later one of two thirds with other items, the first one tried again."""
    path = shared_path(t.spark, "evidence")
    items = t.table("orders").selectExpr("o_custkey as incident_id", "o_orderkey as key")

    def write(rows, day, name):
        groups, relations = rows.select("incident_id").distinct(), rows.selectExpr("incident_id", "key as source")
        return EVT.write_evidence(rows, relations, groups, path, dt.datetime(2024, 2, day, tzinfo=dt.timezone.utc), name)

    write(items, 1, "build-1")
    write(items.where("incident_id % 3 > 0 and key % 2 = 0"), 2, "build-2")
    write(items, 3, "build-1")
    found = EVT.latest_evidence(t.spark, path)["items"]
    return found.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("key").alias("keys"), F.max(F.when(F.dayofmonth("built_at") == 2, 1).otherwise(0)).alias("build")
    )
