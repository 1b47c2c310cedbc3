"""Scalar functions over event, document and page columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import query
from catalog import roles_sql as Q
from faultline.functions import fields as X
from faultline.functions import text as S
from faultline.operators import normalize as N

UTC = dt.timezone.utc


@query(
    "x1_x2_fields",
    Q.cte(Q.EV)
    + f""" SELECT id, {Q.severity("CASE WHEN severity = 'HIGH' THEN 'ERROR' ELSE 'notice' END")} AS severity, message AS message, 'app-' || (user_id % 5) AS service,
    'h' || k AS host, CASE WHEN k % 2 = 0 THEN 'c' || id ELSE 'r' || id END AS request_id, 'mapped ' || k AS mapped_message FROM ev""",
)
def x1(t):
    m = F.create_map(
        *[
            x
            for key, value in {
                "Log-Level": "if(severity = 'HIGH', 'ERROR', 'notice')",
                "msg": "message",
                "text": "'unused'",
                " APP ": "concat('app-', user_id % 5)",
                "hostname": "concat('h', k)",
                "request_id": "if(k % 2 = 0, '', concat('r', id))",
                "correlation-id": "concat('c', id)",
                "My Column": "concat('mapped ', k)",
            }.items()
            for x in (F.lit(key), F.expr(value))
        ]
    )
    e = t.events.withColumn("m", m)
    mapped = X.apply_mapping(F.col("m"), {"message": "my column"})["message"]
    c = X.extract_common(F.col("m"))
    return e.select("id", c["severity"].alias("severity"), c["message"].alias("message"), c["service"].alias("service"),
                    c["host"].alias("host"), c["request_id"].alias("request_id"), mapped.alias("mapped_message"))


@query(
    "x3_validate_mapping",
    Q.cte(Q.EV)
    + """ SELECT 'column ''level'' contains unparseable severity' AS error FROM ev WHERE v >= 400 HAVING count(*) > 0
    UNION ALL SELECT 'column ''nowhere'' for ''host'' not found in sample data'""",
)
def x3(t):
    data = F.create_map(F.lit("level"), F.expr("if(v >= 400, 'loud', 'warn')"), F.lit("msg"), F.col("message"))
    from faultline.sources.logs import validate_mapping

    mapping = {"severity": "level", "message": "msg", "host": "nowhere"}
    return validate_mapping(t.events.select(data.alias("data")), mapping, require_message=True, sample=None)


@query(
    "x4_x21_timestamps",
    Q.cte(Q.EV)
    + """ SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 = 4 THEN us - us % 1000000 - 19800000000 WHEN id % 6 IN (1, 3) THEN us - us % 1000000
      WHEN id % 6 = 2 THEN us - us % 1000 ELSE us END AS parsed_us, CASE WHEN id % 3 = 0 THEN NULL ELSE us - us % 1000000 END AS rfc_us FROM ev""",
)
def x4(t):
    text = """case id % 6 when 0 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") when 1 then date_format(timestamp, 'yyyy-MM-dd HH:mm:ss')
      when 2 then date_format(timestamp, 'yyyy-MM-dd HH:mm:ss,SSS') when 3 then date_format(timestamp, 'yyyy/MM/dd HH:mm:ss')
      when 4 then date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'+05:30'") else 'yesterday' end"""
    rfc = """case id % 3 when 0 then if(id % 2 = 0, ' ', '0001-01-01T00:00:00Z') else date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'") end"""
    return t.events.select(
        "id",
        F.unix_micros(X.parse_ts(F.expr(text))).alias("parsed_us"),
        F.unix_micros(X.parse_rfc3339(F.expr(rfc))).alias("rfc_us"),
    )


@query(
    "x5_x19_x20_severity_and_labels",
    f"""SELECT p_partkey AS id, {Q.severity("p_type")} AS log_severity, CASE WHEN p_partkey % 3 = 0 THEN 'HIGH' WHEN p_partkey % 3 = 1 THEN 'LOW' ELSE 'MEDIUM' END AS label_severity,
    CASE WHEN p_partkey % 2 = 0 THEN 'job ' || p_size ELSE p_brand END AS service, CASE WHEN p_partkey % 5 = 0 THEN 'qa' ELSE 'production' END AS environment,
    p_name AS title FROM part""",
)
def x5(t):
    labels = F.expr(
        """map_filter(map('severity', case p_partkey % 3 when 0 then 'Warning ' when 1 then null else 'odd' end, 'priority', 'low', 'service', if(p_partkey % 2 = 0, '  ', p_brand),
        'job', concat('job ', p_size), 'env', if(p_partkey % 5 = 0, 'qa', null), 'alertname', concat(' ', p_name)), (k, v) -> v is not null)"""
    )
    p = t.table("part").withColumn("labels", labels)
    m = F.col("labels")
    return p.select(
        F.col("p_partkey").alias("id"),
        X.parse_severity(F.col("p_type")).alias("log_severity"),
        X.label_severity(m).alias("label_severity"),
        X.label_service(m).alias("service"),
        X.label_env(m).alias("environment"),
        X.label_title(m).alias("title"),
    )


@query(
    "x9_normalize_name",
    f"SELECT c_custkey AS id, {Q.name('c_name')} AS name FROM customer",
)
def x9(t):
    padded = F.concat(F.lit("  "), F.regexp_replace("c_name", "#", " \t#"), F.lit("\n"))
    return t.table("customer").select(F.col("c_custkey").alias("id"), F.replace(S.norm_name(padded), F.lit(" #"), F.lit("#")).alias("name"))


@query(
    "x15_x16_event_payload",
    Q.cte(Q.EV)
    + """ SELECT id, CASE event_type WHEN 'METRIC' THEN metric_name || '=' || value WHEN 'DEPLOYMENT' THEN version || ' c' || k WHEN 'ALERT' THEN 'alert ' || k
      WHEN 'TRACE' THEN 'op ' || k ELSE message END AS message, CASE WHEN event_type IN ('LOG', 'ALERT') THEN severity END AS severity,
      CASE event_type WHEN 'LOG' THEN trace_id WHEN 'TRACE' THEN span_id WHEN 'DEPLOYMENT' THEN repository WHEN 'ALERT' THEN status ELSE metric_name END AS probe FROM ev""",
)
def x15(t):
    e = t.events.withColumns(
        {
            "name": F.expr("if(event_type = 'ALERT', concat('alert ', k), null)"),
            "operation_name": F.expr("if(event_type = 'TRACE', concat('op ', k), null)"),
            "commit_sha": F.expr("if(event_type = 'DEPLOYMENT', concat('c', k), null)"),
            "normalized_data": F.lit(None).cast("map<string,string>"),
        }
    )
    p = N.event_payload(N.event_message(e))
    key = F.expr("case event_type when 'LOG' then 'trace_id' when 'TRACE' then 'span_id' when 'DEPLOYMENT' then 'repository' when 'ALERT' then 'status' else 'metric_name' end")
    return p.select("id", "message", "severity", F.try_element_at("normalized_data", key).alias("probe"))


@query(
    "x17_normalize_records",
    Q.cte(Q.LINES)
    + f""" SELECT doc_id, line_number, {Q.ws('line')} AS message, {Q.pattern('line')} AS normalized_message, {Q.name('source')} AS service,
    {Q.name('lang')} AS environment, {Q.severity('level')} AS severity FROM lines""",
)
def x17(t):
    r = t.lines.select(
        "doc_id",
        "line_number",
        F.col("line").alias("message"),
        F.concat(F.lit(" "), F.upper("source")).alias("service"),
        X.parse_severity(F.col("level")).alias("severity"),
        *[F.lit(None).cast("string").alias(c) for c in ("host", "request_id", "trace_id")],
        F.create_map(F.lit("environment"), F.concat(F.upper("lang"), F.lit("  "))).alias("raw_data"),
    )
    return N.normalize_records(r).select("doc_id", "line_number", "message", "normalized_message", "service", "environment", "severity")


@query(
    "x18_normalize_events",
    Q.cte(Q.EV)
    + f""" SELECT id, message, CASE WHEN event_type = 'LOG' THEN {Q.pattern('message')} END AS normalized_message,
    CASE WHEN event_type = 'LOG' THEN 'svc a' ELSE ' SVC  A' END AS service FROM ev""",
)
def x18(t):
    e = t.events.withColumns(
        {
            "service": F.lit(" SVC  A"),
            "host": F.lit(None).cast("string"),
            "request_id": F.lit(None).cast("string"),
            "normalized_data": F.lit(None).cast("map<string,string>"),
        }
    )
    n = N.normalize_events(e)
    return n.select("id", "message", F.try_element_at("normalized_data", F.lit("normalized_message")).alias("normalized_message"), "service")


@query(
    "x22_k4_select_logs",
    Q.cte(Q.EV)
    + """ SELECT id, us FROM ev WHERE us BETWEEN 1704844800000000 AND 1705708800000000 AND environment = 'production' AND lower(severity) IN ('high', 'error', 'err')
    ORDER BY us LIMIT 100""",
)
def x22(t):
    start, end = dt.datetime(2024, 1, 10, tzinfo=UTC), dt.datetime(2024, 1, 20, tzinfo=UTC)
    got = N.select_logs(t.events, start, end, environment="production", severity="HIGH", size=100)
    return got.select("id", F.unix_micros("timestamp").alias("us"))


@query(
    "x30_titles_match",
    r"""WITH p AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS b,
      trim(regexp_replace(lower(split_part(p_name, ' ', 2)), '[^a-z0-9]+', ' ', 'g')) AS c FROM part)
    SELECT id, contains(a, b) OR contains(b, a) OR (id % 2 = 0 AND (contains(a, c) OR contains(c, a))) AS matched FROM p""",
)
def x30(t):
    aliases = F.expr("if(p_partkey % 2 = 0, array(split(p_name, ' ')[1]), array('!!'))")
    p = t.table("part")
    return p.select(F.col("p_partkey").alias("id"), S.titles_match(F.concat(F.lit("-"), F.upper("p_name")), F.col("p_type"), aliases).alias("matched"))


def _sql_redact(x: str) -> str:
    for _, rule, replacement in S.REDACTIONS:
        flags = "g"
        for head, extra in (("(?iU)", "i"), ("(?U)", "")):
            if rule.startswith(head):
                rule, flags = rule[len(head) :], "g" + extra
                break
        x = f"regexp_replace({x}, {Q._q(rule)}, {Q._q(replacement.replace('$', chr(92)))}, '{flags}')"
    return x


@query("x31_redact_documents", f"SELECT doc_id, {_sql_redact('text')} AS text FROM documents")
def x31(t):
    return S.redact_columns(t.wide("documents").select("doc_id", "text"), ["text"])


@query("x31_redact_pages", f"SELECT page_id, md5({_sql_redact('html')}) AS digest FROM pages")
def x31b(t):
    return S.redact_columns(t.table("pages"), ["html"]).select("page_id", F.md5("html").alias("digest"))


def _sql_hits(rule: str) -> str:
    flags = "'i'" if rule.startswith("(?iU)") else "''"
    return f"len(regexp_extract_all(text, {Q._q(rule.removeprefix('(?iU)').removeprefix('(?U)'))}, 0, {flags}))"


@query(
    "x31_redaction_hits",
    "SELECT " + ", ".join(f"CAST(sum({_sql_hits(rule)}) AS BIGINT) AS {name}" for name, rule, _ in S.REDACTIONS) + " FROM documents",
)
def x31c(t):
    hits = S.redaction_hits(F.col("text"))
    return t.table("documents").agg(*[F.sum(c).cast("bigint").alias(n) for n, c in hits.items()])


@query("f2_sql_functions", Q.cte(Q.LINES, Q.REC) + f" SELECT doc_id, line_number, pattern, {Q.fingerprint(Q._q('LOG'), 'pattern', 'service', 'severity', Q._q('s'))} AS fingerprint FROM rec")
def f2(t):
    from faultline.functions.sql import register_sql_functions

    register_sql_functions(t.spark)
    t.lines.createOrReplaceTempView("faultline_lines")
    return t.spark.sql(
        """SELECT doc_id, line_number, pattern, event_fingerprint('LOG', 's', source, severity, pattern) AS fingerprint
        FROM (SELECT *, message_pattern(line) AS pattern, parse_severity(level) AS severity FROM faultline_lines)"""
    )
