"""The roles of ``roles`` as SQL, for the checks."""

from __future__ import annotations

from faultline.functions import text as S


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ws(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def name(x: str) -> str:
    return f"lower({ws(x)})"


def pattern(x: str) -> str:
    out = ws(x)
    for rule, token, flags in (
        (S.UUID, "{uuid}", "gi"),
        (S.IPV6, "{ip}", "gi"),
        (S.IPV4, "{ip}", "g"),
        (S.ISO_TIME, "{timestamp}", "g"),
        (S.HEX_HASH, "{hash}", "gi"),
        (S.REQUEST_ID, "{request_id}", "gi"),
        (S.NUMBER, "{id}", "g"),
    ):
        out = f"regexp_replace({out}, {_q(rule)}, '{token}', '{flags}')"
    return out


def json_text(x: str) -> str:
    """JSON string of a text, ASCII only, lower-case escapes."""
    body = f"CAST(to_json(CAST({x} AS VARCHAR)) AS VARCHAR)"
    return (
        f"array_to_string(list_transform(regexp_extract_all({body}, '(?s).'), "
        "lambda c: CASE WHEN unicode(c) > 127 THEN printf('\\u%04x', unicode(c)) ELSE c END), '')"
    )


def fingerprint(kind: str, message: str, service: str, severity: str, source: str) -> str:
    return (
        f"sha256('{{\"event_type\":' || {json_text(kind)} || ',\"normalized_message\":' || {json_text(f'trim(coalesce({message}, {_q('')}))')}"
        f" || ',\"service\":' || {json_text(f'coalesce({service}, {_q('')})')} || ',\"severity\":' || "
        f"{json_text(f'coalesce({severity}, {_q('')})')} || ',\"source\":' || {json_text(source)} || '}}')"
    )


def severity(x: str) -> str:
    from faultline.functions.fields import SEVERITY_TOKENS

    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY_TOKENS.items())
    return f"CASE lower(trim({x})) {arms} END"


def duration(us: str) -> str:
    s = f"(({us}) // 1000000)"
    return f"""CASE WHEN {s} < 60 THEN {s} || ' seconds'
      WHEN {s} < 3600 AND {s} % 60 > 0 THEN ({s} // 60) || ' minutes ' || ({s} % 60) || ' seconds'
      WHEN {s} < 3600 THEN ({s} // 60) || ' minutes'
      WHEN ({s} // 60) % 60 > 0 THEN ({s} // 3600) || ' hours ' || (({s} // 60) % 60) || ' minutes'
      ELSE ({s} // 3600) || ' hours' END"""


SVC = "svc AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey + 1 AS BIGINT) AS project_id, lower(n_name) AS name FROM nation)"
PRJ = "prj AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name FROM region)"

EV = """ev0 AS (
  SELECT event_id, user_id, value AS v, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'error' THEN 'LOG' WHEN 'click' THEN 'METRIC' WHEN 'purchase' THEN 'ALERT'
      WHEN 'signup' THEN 'DEPLOYMENT' ELSE 'TRACE' END AS et FROM events),
ev AS (
  SELECT event_id AS id, 1 + (event_id // 50) % 5 AS project_id,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 25 END AS service_id, et AS event_type, ts, epoch_us(ts) AS us,
    CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'staging' ELSE 'production' END AS environment, 'stream' AS source,
    CASE WHEN et = 'LOG' THEN CASE WHEN v >= 20 THEN 'HIGH' ELSE 'LOW' END
         WHEN et = 'ALERT' THEN CASE WHEN v > 100 THEN 'CRITICAL' ELSE 'HIGH' END END AS severity,
    CASE WHEN et = 'LOG' THEN 'request ' || k || ' failed for user ' || user_id || ' in module ' || chr(CAST(97 + k % 7 AS INTEGER))
         WHEN et = 'ALERT' THEN 'latency alert on route ' || (k % 5)
         WHEN et = 'METRIC' THEN 'latency_' || (user_id % 4)
         WHEN et = 'DEPLOYMENT' THEN 'release ' || k ELSE 'span ' || k END AS message,
    CASE WHEN et = 'METRIC' THEN 'latency_' || (user_id % 4) END AS metric_name,
    CASE WHEN et = 'METRIC' THEN v END AS value,
    CASE WHEN et = 'ALERT' THEN CASE WHEN event_id % 4 = 0 THEN 'RESOLVED' ELSE 'FIRING' END END AS status,
    CASE WHEN et IN ('LOG', 'TRACE') THEN 't' || (event_id // 8) END AS trace_id,
    CASE WHEN et = 'TRACE' THEN 's' || event_id END AS span_id,
    CASE WHEN et = 'TRACE' THEN 's' || (event_id - 1) END AS parent_span_id,
    CASE WHEN et = 'DEPLOYMENT' THEN 'org/nation_' || (user_id % 25) END AS repository,
    CASE WHEN et = 'DEPLOYMENT' THEN 'v' || k END AS version,
    CASE WHEN et = 'DEPLOYMENT' THEN ['src/module ' || chr(CAST(97 + k % 7 AS INTEGER)), 'docs/readme.md'] END AS changed_files,
    CASE WHEN et = 'LOG' AND event_id % 2 = 0 THEN (1 + (event_id // 50) % 5) * 100 + k % 7 END AS error_group_id,
    user_id, k, v
  FROM ev0)"""

GRP = """grp AS (
  SELECT project_id * 100 + m AS id, project_id, CASE WHEN m % 2 = 0 THEN NULL ELSE s END AS service_id,
    'request {id} failed for user {id} in module ' || chr(CAST(97 + m AS INTEGER)) AS normalized_message, 'HIGH' AS severity,
    occurrence_count, first_us, last_us
  FROM (SELECT project_id, k % 7 AS m, count(*) AS occurrence_count, min(us) AS first_us, max(us) AS last_us, max(service_id) AS s
        FROM ev WHERE event_type = 'LOG' GROUP BY ALL))"""

INC = """inc0 AS (
  SELECT o_custkey AS c, min(o_orderpriority) AS p, arg_min(o_orderstatus, o_orderkey) AS s, count(*) AS n FROM orders GROUP BY 1),
inc AS (
  SELECT c AS id, 1 + c % 5 AS project_id, CASE WHEN c % 7 = 0 THEN NULL ELSE c % 25 END AS service_id,
    CASE WHEN c % 3 = 0 THEN 'staging' ELSE 'production' END AS environment,
    CASE substring(p, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' WHEN '4' THEN 'INFO' ELSE 'LOW' END AS severity,
    CASE s WHEN 'F' THEN 'RESOLVED' WHEN 'P' THEN 'IDENTIFIED' ELSE 'OPEN' END AS status,
    lower(substring(p, 3)) || ' order backlog for customer ' || c AS title,
    1704067200000000 + (c * 37 % 41760) * 60000000 AS started_us,
    CASE WHEN s <> 'O' OR c % 5 > 0 THEN 1704067200000000 + (c * 37 % 41760) * 60000000 + 10800000000 END AS ended_us,
    n AS occurrence_count
  FROM inc0)"""

LINES = """lines0 AS (
  SELECT doc_id, lang, source, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line
  FROM documents),
lines AS (
  SELECT 'doc-' || doc_id AS file, doc_id, CAST(n AS BIGINT) AS line_number, line, source, lang,
    1704067200000000 + doc_id * 60000000 + (n - 1) * 1000000 AS us,
    CASE doc_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 2 THEN 'info' ELSE 'fatal' END AS level
  FROM lines0 WHERE trim(line) <> '')"""

REC = f"""rec AS (
  SELECT 1 + doc_id % 5 AS project_id, file, doc_id, line_number, us, {severity('level')} AS severity,
    {name('source')} AS service, {name('lang')} AS environment, {ws('line')} AS message, {pattern('line')} AS pattern
  FROM lines)"""

NOW_US = 1706659200000000

WIN = f"win AS (SELECT *, started_us - 86400000000 AS w0, coalesce(ended_us, {NOW_US}) AS w1 FROM inc)"

ME = """me AS MATERIALIZED (
  SELECT w.id AS incident_id, w.started_us, e.* FROM win w JOIN ev e ON e.project_id = w.project_id AND e.us BETWEEN w.w0 AND w.w1
    AND (e.environment IS NULL OR e.environment = w.environment)
    AND (w.service_id IS NULL OR e.service_id IS NULL OR e.service_id = w.service_id))"""

MG = """mg AS (
  SELECT w.id AS incident_id, w.started_us, g.* FROM win w JOIN grp g ON g.project_id = w.project_id
    AND g.first_us <= w.w1 AND g.last_us >= w.w0
    AND (w.service_id IS NULL OR g.service_id IS NULL OR g.service_id = w.service_id))"""


def iso(us: str) -> str:
    fraction = f"CASE WHEN ({us}) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0') END"
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || {fraction} || '+00:00'"


EN = f"""en AS MATERIALIZED (
  SELECT incident_id, 'event:' || id AS id, lower(event_type) AS category, us, message AS title, message AS summary, severity,
    id AS event_id, error_group_id, service_id, metric_name, value, status, trace_id, span_id, parent_span_id, repository,
    version, changed_files, NULL::BIGINT AS occurrence_count, started_us FROM me
  UNION ALL
  SELECT incident_id, 'error_group:' || id, 'error', first_us, normalized_message,
    'seen ' || occurrence_count || ' times; last at ' || {iso('last_us')}, severity, NULL, id, service_id,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, occurrence_count, started_us
  FROM mg WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.incident_id = mg.incident_id AND me.error_group_id = mg.id))"""


def rolling(source: str, keys: str, value: str = "value", us: str = "us", tie: str = "id") -> str:
    """CTEs r0 and roll: statistics of the 20 points before each point."""
    return f"""r0 AS (
  SELECT *, count({value}) OVER w AS n, avg({value}) OVER w AS mean, coalesce(stddev_samp({value}) OVER w, 0.0) AS sd,
    min({value}) OVER w AS mn, max({value}) OVER w AS mx, list({value}) OVER w AS hist,
    lag({value}) OVER (PARTITION BY {keys} ORDER BY {us}, {tie}) AS prev
  FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY {us}, {tie} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
roll AS MATERIALIZED (
  SELECT *, ({value} - mean) / greatest(sd, 1e-9) AS z,
    CASE WHEN coalesce(prev, mean) <> 0 THEN ({value} - coalesce(prev, mean)) / abs(coalesce(prev, mean)) * 100.0 END AS pct,
    CASE WHEN n > 0 THEN (len(list_filter(hist, lambda h: h < {value})) + len(list_filter(hist, lambda h: h = {value})) / 2.0)
      / n * 100.0 ELSE 50.0 END AS pr
  FROM r0)"""


FIRED = "(abs(z) >= 2.5 OR abs(pct) >= 50 OR pr <= 5 OR pr >= 95)"

AN = f"""pts AS (SELECT incident_id, coalesce(metric_name, title) AS series, us, id, value FROM en WHERE category = 'metric' AND value IS NOT NULL),
{rolling('pts', 'incident_id, series')},
fired AS MATERIALIZED (SELECT DISTINCT incident_id, series, us FROM roll WHERE n >= 4 AND {FIRED}),
an AS MATERIALIZED (
  SELECT en.*, (f.us IS NOT NULL) AS anomaly, svc.name AS service_name
  FROM en LEFT JOIN fired f ON en.category = 'metric' AND f.incident_id = en.incident_id
    AND f.series = coalesce(en.metric_name, en.title) AND f.us = en.us
  LEFT JOIN svc ON svc.id = en.service_id)"""

IS_ERROR = "(category = 'error' OR (category = 'log' AND coalesce(severity IN ('HIGH', 'CRITICAL'), false)))"
IS_ANOMALY = "(category = 'metric' OR coalesce(severity IN ('MEDIUM', 'HIGH', 'CRITICAL'), false))"

MARK = f"""mk0 AS (
  SELECT incident_id,
    arg_min(an, (us, id)) FILTER (WHERE {IS_ANOMALY}) AS fa,
    arg_min(an, (us, id)) FILTER (WHERE category = 'error') AS fe,
    arg_min(an, (us, id)) FILTER (WHERE category = 'log' AND severity IN ('HIGH', 'CRITICAL')) AS fl,
    arg_min(an, (us, id)) FILTER (WHERE category = 'alert') AS fal,
    arg_max(an, (us, id)) FILTER (WHERE category = 'deployment' AND us BETWEEN started_us - 86400000000 AND started_us) AS dep,
    arg_min(an, (us, id)) FILTER (WHERE category = 'alert' AND upper(status) = 'RESOLVED') AS res
  FROM an GROUP BY 1),
mk AS (
  SELECT i.id AS incident_id, i.service_id AS incident_service_id, i.started_us, i.ended_us, i.status AS incident_status, fa,
    CASE WHEN fe IS NOT NULL THEN fe ELSE fl END AS er, fal, dep, res,
    CASE WHEN i.ended_us IS NOT NULL AND i.status IN ('RESOLVED', 'CLOSED') THEN 'incident:' || i.id || ':recovery' ELSE res.id END AS rec_id,
    CASE WHEN i.ended_us IS NOT NULL AND i.status IN ('RESOLVED', 'CLOSED') THEN i.ended_us ELSE res.us END AS rec_us
  FROM inc i LEFT JOIN mk0 ON mk0.incident_id = i.id)"""


def _asof(name: str, source: str, target: str, lag: int, strict: bool = True) -> str:
    op = ">" if strict else ">="
    return f"""{name} AS (
  SELECT s.incident_id, s.id AS sid, arg_min(t, (t.us, t.id)) AS tgt
  FROM an s JOIN an t ON s.incident_id = t.incident_id AND t.us {op} s.us AND t.us <= s.us + {lag} AND t.id <> s.id
  WHERE {source.replace('@', 's.')} AND {target.replace('@', 't.')} GROUP BY 1, 2)"""


_ERR = "(@category = 'error' OR (@category = 'log' AND coalesce(@severity IN ('HIGH', 'CRITICAL'), false)))"

CORR = f"""{_asof('c1', "@category = 'deployment'", _ERR, 7200000000)},
{_asof('c2', "@category = 'metric' AND @anomaly", _ERR, 1800000000)},
{_asof('c3', _ERR, "@category = 'alert' AND NOT coalesce(upper(@status) = 'RESOLVED', false)", 900000000)},
call AS (
  SELECT 'deployment_to_error' AS kind, 7200000000 AS mx, * FROM c1
  UNION ALL SELECT 'metric_anomaly_to_error', 1800000000, * FROM c2
  UNION ALL SELECT 'error_to_alert', 900000000, * FROM c3),
corr0 AS (
  SELECT c.incident_id, c.kind, s.id AS source_id, s.us AS source_us, s.title AS source_title, c.tgt.id AS target_id,
    c.tgt.us AS target_us, c.tgt.title AS target_title, c.tgt.us - s.us AS lag_us, 1.0 - (c.tgt.us - s.us)::DOUBLE / c.mx AS raw,
    CASE WHEN c.kind = 'metric_anomaly_to_error' THEN coalesce(s.metric_name, s.title) ELSE s.title END AS sname
  FROM call c JOIN an s ON s.incident_id = c.incident_id AND s.id = c.sid),
corr AS (
  SELECT incident_id, kind, source_id, source_us, source_title, target_id, target_us, target_title, lag_us, round(raw, 6) AS score,
    CASE kind WHEN 'deployment_to_error' THEN 'Deployment ''' WHEN 'metric_anomaly_to_error' THEN 'Metric anomaly on ''' ELSE 'Error ''' END
    || sname || CASE kind WHEN 'error_to_alert' THEN ''' preceded alert ''' ELSE ''' preceded error ''' END || target_title
    || ''' by ' || {duration('lag_us')} AS reason
  FROM corr0 WHERE raw >= 0.1)"""

TIMELINE = (EV, GRP, INC, SVC, WIN, ME, MG, EN, AN)


def _block(s: str, t: str) -> str:
    """Length and place of the longest common substring, the first in s and then in t."""
    longest = f"len(list_filter(range(1, length({s}) - i + 2), lambda n: contains({t}, substr({s}, i, n))))"
    return f"coalesce(list_max(list_transform(range(1, length({s}) + 1), lambda i: {{'n': {longest}, 'i': -i}})), {{'n': 0, 'i': 0}})"


def ratios(pairs: str) -> str:
    """CTEs rw and ratio(a, b, ratio): sequence ratios of the distinct (a, b) of ``pairs``; texts below 200 letters."""
    return f"""rp AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> ''),
rw AS (
  SELECT a, b, lower(a) AS s, lower(b) AS t, {_block('lower(a)', 'lower(b)')} AS m, 0 AS depth FROM rp
  UNION ALL
  SELECT a, b, s, t, {_block('s', 't')} AS m, depth FROM (
    SELECT a, b, side.s AS s, side.t AS t, depth + 1 AS depth FROM (
      SELECT a, b, depth, unnest([{{'s': substr(s, 1, -m.i - 1), 't': substr(t, 1, instr(t, substr(s, -m.i, m.n)) - 1)}},
        {{'s': substr(s, -m.i + m.n), 't': substr(t, instr(t, substr(s, -m.i, m.n)) + m.n)}}]) AS side FROM rw WHERE m.n > 0)) WHERE s <> '' AND t <> ''),
ratio AS (SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE 2.0 * sum(m.n) / (length(a) + length(b)) END AS ratio FROM rw GROUP BY a, b)"""


def half_up(x: str, digits: int) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 18)), {digits}) AS DOUBLE)"
