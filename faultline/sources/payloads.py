"""Landed API payloads (one JSON text per row) to canonical rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import fields as X
from faultline.functions.text import blank_to_null

METRIC_SCHEMA = (
    "status string, errorType string, error string, data struct<resultType string, result string>"
)
DEPLOYMENT_COLUMNS = (
    "timestamp",
    "source",
    "source_type",
    "source_id",
    "service",
    "environment",
    "version",
    "commit_sha",
    "author",
    "repository",
    "changed_files",
)
GOOD_RESULTS = ("succeeded", "partiallySucceeded")


def flatten_metric_payload(
    df: DataFrame, source: str, service: str | None = None, environment: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Metric API responses (columns query, payload) to (metric rows, failed responses)."""
    p = df.withColumn("p", F.from_json("payload", METRIC_SCHEMA))
    good = F.coalesce(F.col("p.status") == "success", F.lit(False))
    failed = p.filter(~good).select(
        "query",
        F.concat(
            F.coalesce("p.errorType", F.lit("unknown")),
            F.lit(": "),
            F.coalesce("p.error", F.lit("prometheus query failed")),
        ).alias("error"),
    )
    kind, result = F.col("p.data.resultType"), F.col("p.data.result")
    series_type = "array<struct<metric:map<string,string>,value:array<string>,values:array<array<string>>>>"
    sample = "struct<metric:map<string,string>,sample:array<string>>"
    series = F.from_json(result, series_type)
    vector = F.transform(series, lambda s: F.struct(s["metric"].alias("metric"), s["value"].alias("sample")))
    matrix = F.flatten(
        F.transform(
            series,
            lambda s: F.coalesce(
                F.transform(s["values"], lambda v: F.struct(s["metric"].alias("metric"), v.alias("sample"))),
                F.array().cast(f"array<{sample}>"),
            ),
        )
    )
    named = F.create_map(F.lit("__name__"), F.col("query"))
    scalar = F.array(F.struct(named.alias("metric"), F.from_json(result, "array<string>").alias("sample")))
    samples = F.when(kind == "vector", vector).when(kind == "matrix", matrix).when(kind == "scalar", scalar)
    rows = p.filter(good).select("query", F.explode(samples).alias("s")).filter(F.size("s.sample") >= 2)
    metric = F.coalesce("s.metric", F.create_map().cast("map<string,string>"))
    return (
        rows.select(
            X.parse_epoch_seconds(F.col("s.sample")[0]).alias("timestamp"),
            F.lit(source).alias("source"),
            F.lit("prometheus").alias("source_type"),
            F.lit(service).cast("string").alias("service"),
            F.lit(environment).cast("string").alias("environment"),
            F.coalesce(F.try_element_at(metric, F.lit("__name__")), F.lit("unknown_metric")).alias("metric_name"),
            X.float_value(F.col("s.sample")[1]).alias("value"),
            F.map_filter(metric, lambda k, _: k != "__name__").alias("labels"),
            "query",
        ),
        failed,
    )


@dataclass(frozen=True)
class LogFields:
    """Field names of a log source, and defaults where a row has none."""

    timestamp: str = "@timestamp"
    message: str = "message"
    service: str = "service"
    environment: str = "environment"
    severity: str = "severity"
    host: str = "host"
    request_id: str = "request_id"
    trace_id: str = "trace_id"
    id: str = "id"
    default_service: str | None = None
    default_environment: str | None = None


def _log_row(get, cfg: LogFields, source: str, source_type: str, source_id: Column, timestamp: Column) -> list[Column]:
    return [
        timestamp.alias("timestamp"),
        F.lit(source).alias("source"),
        F.lit(source_type).alias("source_type"),
        source_id.cast("string").alias("source_id"),
        F.coalesce(blank_to_null(get(cfg.service)), F.lit(cfg.default_service).cast("string")).alias("service"),
        F.coalesce(blank_to_null(get(cfg.environment)), F.lit(cfg.default_environment).cast("string")).alias("environment"),
        F.trim(get(cfg.message)).alias("message"),
        X.parse_severity(get(cfg.severity)).alias("severity"),
        get(cfg.host).alias("host"),
        get(cfg.request_id).alias("request_id"),
        get(cfg.trace_id).alias("trace_id"),
    ]


def _complete(df: DataFrame) -> DataFrame:
    return df.filter((F.col("message") != "") & F.col("timestamp").isNotNull())


def flatten_search_hits(df: DataFrame, cfg: LogFields, source: str, source_type: str = "search") -> DataFrame:
    """Search responses to log events; hits without source, message or time are dropped."""
    hit = "struct<_index:string,_id:string,_source:string>"
    hits = F.from_json("payload", f"hits struct<hits:array<{hit}>>")["hits"]["hits"]
    rows = df.select(F.explode(hits).alias("h")).withColumn("m", F.from_json("h._source", "map<string,string>"))
    rows = rows.filter(F.col("m").isNotNull())

    def get(name: str) -> Column:
        return F.try_element_at("m", F.lit(name))

    raw = F.create_map(
        F.lit("_index"), F.col("h._index"), F.lit("_id"), F.col("h._id"), F.lit("_source"), F.col("h._source")
    )
    text = get(cfg.timestamp)
    number = text.try_cast("double")
    quoted = F.contains(F.col("h._source"), F.concat(F.lit('"'), text, F.lit('"')))
    when = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.when(~quoted, X.parse_epoch(number))).otherwise(X.parse_ts(text))
    return _complete(
        rows.select(*_log_row(get, cfg, source, source_type, F.col("h._id"), when), raw.alias("raw_data"))
    )


def rows_to_log_events(df: DataFrame, cfg: LogFields, source: str) -> DataFrame:
    """Table rows to log events; optional columns may be absent.

    Only plain projections and filters stand between the result and the
    table, so column pruning and filters reach a JDBC or parquet source.
    """
    have = set(df.columns)

    def get(name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if name in have else F.lit(None).cast("string")

    kind = dict(df.dtypes).get(cfg.timestamp, "string")
    raw_ts = F.col(f"`{cfg.timestamp}`")
    if kind.startswith("timestamp"):
        when = raw_ts.cast("timestamp")
    elif kind == "string":
        when = X.parse_ts(raw_ts)
    else:
        when = X.parse_epoch(raw_ts.cast("double"))
    rows = df.select(*_log_row(get, cfg, source, "database", get(cfg.id), when))
    return _complete(rows)


def _items(column: str, item: str) -> Column:
    """Elements of a JSON array, or of the ``value`` list that wraps one."""
    wrapped = F.from_json(column, f"value array<struct<{item}>>")["value"]
    plain = F.from_json(column, f"array<struct<{item}>>")
    return F.explode(F.when(F.startswith(F.ltrim(column), F.lit("[")), plain).otherwise(wrapped))


def _feed(df: DataFrame, source: str, source_type: str, files: DataFrame | None, service, environment) -> DataFrame:
    base = df.withColumns(
        {
            "source": F.lit(source),
            "source_type": F.lit(source_type),
            "service": F.lit(service).cast("string"),
            "environment": F.coalesce(F.lit(environment).cast("string"), F.col("environment")),
            "source_id": F.col("source_id").cast("string"),
        }
    )
    empty = F.array().cast("array<string>")
    if files is None:
        base = base.withColumn("changed_files", empty)
    else:
        listed = files.select(F.col("sha").alias("commit_sha"), F.col("files").alias("_f"))
        base = base.join(listed, "commit_sha", "left").withColumn("changed_files", F.coalesce("_f", empty))
    return base.select(*DEPLOYMENT_COLUMNS)


def deployments_from_codehost(
    deployments: DataFrame,
    releases: DataFrame,
    source: str,
    commit_files: DataFrame | None = None,
    service: str | None = None,
    environment: str | None = None,
) -> DataFrame:
    """Code-host deployments and published releases as deployment events.

    Both inputs have repository and payload. Sort with ``order_feed``.
    """
    d_item = "id:bigint,sha:string,ref:string,environment:string,created_at:string,creator:struct<login:string>"
    d = deployments.select("repository", _items("payload", d_item).alias("x")).select(
        X.parse_ts(F.col("x.created_at")).alias("timestamp"),
        F.col("x.id").alias("source_id"),
        "x.environment",
        F.col("x.ref").alias("version"),
        F.col("x.sha").alias("commit_sha"),
        F.col("x.creator.login").alias("author"),
        "repository",
    )
    d = d.dropna(subset=["source_id", "commit_sha", "version", "environment", "timestamp"])
    r_item = "id:bigint,tag_name:string,target_commitish:string,published_at:string,author:struct<login:string>"
    r = releases.select("repository", _items("payload", r_item).alias("x")).select(
        X.parse_ts(F.col("x.published_at")).alias("timestamp"),
        F.col("x.id").alias("source_id"),
        F.lit(None).cast("string").alias("environment"),
        F.col("x.tag_name").alias("version"),
        F.col("x.target_commitish").alias("commit_sha"),
        F.col("x.author.login").alias("author"),
        "repository",
    )
    r = r.dropna(subset=["source_id", "version", "commit_sha", "timestamp"])
    return _feed(d.unionByName(r), source, "github", commit_files, service, environment)


def _person(c: str) -> Column:
    return F.coalesce(blank_to_null(F.col(f"{c}.displayName")), F.col(f"{c}.uniqueName"))


def deployments_from_ci(
    builds: DataFrame,
    releases: DataFrame,
    deployments: DataFrame,
    source: str,
    commit_files: DataFrame | None = None,
    service: str | None = None,
    environment: str | None = None,
) -> DataFrame:
    """CI builds, releases and release deployments as deployment events."""
    person = "struct<displayName:string,uniqueName:string>"
    none = F.lit(None).cast("string")

    def good(c: str) -> Column:
        return F.col(c).isNull() | F.col(c).isin(*GOOD_RESULTS)

    b_item = f"id:bigint,buildNumber:string,result:string,sourceVersion:string,queueTime:string,finishTime:string,requestedBy:{person}"
    b = builds.select("repository", _items("payload", b_item).alias("x")).filter(good("x.result")).select(
        F.coalesce(X.parse_ts(F.col("x.finishTime")), X.parse_ts(F.col("x.queueTime"))).alias("timestamp"),
        F.col("x.id").alias("source_id"),
        none.alias("environment"),
        F.col("x.buildNumber").alias("version"),
        F.col("x.sourceVersion").alias("commit_sha"),
        _person("x.requestedBy").alias("author"),
        "repository",
    )
    b = b.dropna(subset=["source_id", "version", "timestamp"])
    r_item = f"id:bigint,name:string,createdOn:string,createdBy:{person}"
    r = releases.select("repository", _items("payload", r_item).alias("x")).select(
        X.parse_ts(F.col("x.createdOn")).alias("timestamp"),
        F.col("x.id").alias("source_id"),
        none.alias("environment"),
        F.col("x.name").alias("version"),
        none.alias("commit_sha"),
        _person("x.createdBy").alias("author"),
        "repository",
    )
    r = r.dropna(subset=["source_id", "version", "timestamp"])
    d_item = (
        "id:bigint,deploymentStatus:string,status:string,startedOn:string,queueTime:string,completedOn:string,"
        "modifiedOn:string,release:struct<id:bigint,name:string>,releaseEnvironment:struct<name:string>,"
        f"environment:struct<name:string>,requestedFor:{person},requestedBy:{person}"
    )
    d = deployments.select("repository", _items("payload", d_item).alias("x"))
    d = d.withColumn("_status", F.coalesce(blank_to_null(F.col("x.deploymentStatus")), F.col("x.status")))
    started = F.coalesce(blank_to_null(F.col("x.startedOn")), F.col("x.queueTime"))
    completed = F.coalesce(blank_to_null(F.col("x.completedOn")), F.col("x.modifiedOn"))
    d = d.filter(good("_status")).select(
        F.coalesce(X.parse_ts(completed), X.parse_ts(started)).alias("timestamp"),
        F.col("x.id").alias("source_id"),
        F.coalesce("x.releaseEnvironment", "x.environment")["name"].alias("environment"),
        F.col("x.release.name").alias("version"),
        none.alias("commit_sha"),
        F.coalesce(_person("x.requestedFor"), _person("x.requestedBy")).alias("author"),
        "repository",
    )
    d = d.dropna(subset=["source_id", "timestamp"])
    return _feed(b.unionByName(r).unionByName(d), source, "azure_devops", commit_files, service, environment)


def order_feed(feed: DataFrame) -> DataFrame:
    return feed.orderBy("timestamp")


def flatten_commits(df: DataFrame) -> DataFrame:
    """Commits of code hosts and CI pages: sha, message, author, time.

    A code-host commit needs a time (author's, else committer's).
    """
    who = "struct<name:string,date:string>"
    item = (
        f"sha:string,commit:struct<message:string,author:{who},committer:{who}>,"
        f"commitId:string,comment:string,author:struct<name:string,date:string>"
    )
    x = df.select("repository", _items("payload", item).alias("x"))
    at = F.coalesce(X.parse_ts(F.col("x.commit.author.date")), X.parse_ts(F.col("x.commit.committer.date")))
    host = (F.col("x.sha").isNotNull()) & F.col("x.commit.message").isNotNull() & at.isNotNull()
    ci = F.col("x.commitId").isNotNull() & F.col("x.comment").isNotNull()
    return x.filter(host | ci).select(
        "repository",
        F.when(host, F.col("x.sha")).otherwise(F.col("x.commitId")).alias("sha"),
        F.when(host, F.col("x.commit.message")).otherwise(F.col("x.comment")).alias("message"),
        F.when(host, F.col("x.commit.author.name")).otherwise(F.col("x.author.name")).alias("author"),
        F.when(host, at).otherwise(X.parse_ts(F.col("x.author.date"))).alias("committed_at"),
    )


def flatten_pull_requests(df: DataFrame) -> DataFrame:
    item = (
        "number:bigint,title:string,state:string,created_at:string,merged_at:string,"
        "user:struct<login:string>,head:struct<sha:string>"
    )
    rows = df.select("repository", _items("payload", item).alias("x")).select(
        "repository",
        "x.number",
        "x.title",
        "x.state",
        F.col("x.user.login").alias("author"),
        X.parse_ts(F.col("x.created_at")).alias("created_at"),
        X.parse_ts(F.col("x.merged_at")).alias("merged_at"),
        F.col("x.head.sha").alias("head_sha"),
    )
    return rows.dropna(subset=["number", "title", "state", "created_at"])


def flatten_repositories(df: DataFrame) -> DataFrame:
    item = (
        "id:string,name:string,full_name:string,default_branch:string,defaultBranch:string,"
        "remoteUrl:string,html_url:string,project:struct<name:string>"
    )
    rows = df.select(_items("payload", item).alias("x")).select(
        "x.id",
        "x.name",
        F.coalesce("x.full_name", "x.name").alias("full_name"),
        F.coalesce("x.default_branch", "x.defaultBranch").alias("default_branch"),
        F.coalesce("x.html_url", "x.remoteUrl").alias("url"),
        F.col("x.project.name").alias("project"),
    )
    return rows.dropna(subset=["id", "name"])


def flatten_projects(df: DataFrame) -> DataFrame:
    rows = df.select(_items("payload", "id:string,name:string,description:string,state:string").alias("x")).select("x.*")
    return rows.dropna(subset=["id", "name"])


def commit_files(df: DataFrame) -> DataFrame:
    """Changed files per commit from code-host lists or CI change sets.

    Input rows have sha and payload. Entries without a file name are
    dropped; missing counts are 0.
    """
    item = "filename:string,status:string,additions:bigint,deletions:bigint,changes:bigint,changeType:string,item:struct<path:string>"
    changes = F.from_json("payload", f"changes array<struct<{item}>>")["changes"]
    body = df.select("sha", F.coalesce(changes, F.from_json("payload", f"value array<struct<{item}>>")["value"]).alias("w"), "payload")
    plain = F.from_json("payload", f"array<struct<{item}>>")
    rows = body.select("sha", F.posexplode(F.when(F.startswith(F.ltrim("payload"), F.lit("[")), plain).otherwise(F.col("w"))).alias("p", "x"))
    rows = rows.withColumn("file", F.coalesce("x.filename", "x.item.path")).filter(F.col("file").isNotNull())

    def total(name: str) -> Column:
        return F.sum(F.coalesce(F.col(f"x.{name}"), F.lit(0))).alias(name)

    return rows.groupBy("sha").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "file"))), lambda s: s["file"]).alias("files"),
        total("additions"),
        total("deletions"),
        total("changes"),
    )


ALERT_SCHEMA = """
receiver string, status string, commonLabels map<string,string>, commonAnnotations map<string,string>,
alerts array<struct<status:string,labels:map<string,string>,annotations:map<string,string>,
startsAt:string,endsAt:string,generatorURL:string,fingerprint:string>>
"""


def explode_alerts(df: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Alert webhooks to (alert events, rejected alerts).

    Own labels and annotations override common ones. An alert needs a known
    status and an alertname; a bad one is set aside alone. ``now`` stands in
    where an alert has no time. ``index`` keeps the order inside a payload.
    """
    keep = [c for c in df.columns if c != "payload"]
    p = df.select(*keep, F.from_json("payload", ALERT_SCHEMA).alias("p"))
    a = p.select(*keep, "p.receiver", "p.commonLabels", "p.commonAnnotations", F.posexplode("p.alerts").alias("index", "a"))
    empty = F.create_map().cast("map<string,string>")

    def merged(common: str, own: str) -> Column:
        return F.map_concat(F.coalesce(common, empty), F.coalesce(own, empty))

    a = a.withColumns(
        {
            "labels": merged("commonLabels", "a.labels"),
            "annotations": merged("commonAnnotations", "a.annotations"),
            "_starts": X.parse_rfc3339(F.col("a.startsAt")),
            "_ends": X.parse_rfc3339(F.col("a.endsAt")),
            "_status": F.upper(F.trim("a.status")),
        }
    )
    labels = F.col("labels")
    moment = now if isinstance(now, Column) else F.lit(now)
    firing = F.coalesce("_starts", moment)
    resolved = F.coalesce("_ends", "_starts", moment)
    error = F.when(~F.coalesce(F.col("_status").isin("FIRING", "RESOLVED"), F.lit(False)), "unsupported alert status").when(
        X.label_title(labels).isNull(), "alert labels must include alertname"
    )
    a = a.withColumn("_error", error)
    events = a.filter(F.col("_error").isNull()).select(
        *keep,
        F.col("index").cast("bigint").alias("index"),
        F.when(F.col("_status") == "FIRING", firing).otherwise(resolved).alias("timestamp"),
        F.concat(F.lit("alertmanager:"), "receiver").alias("source"),
        F.lit("alertmanager").alias("source_type"),
        F.col("a.fingerprint").alias("source_id"),
        X.label_service(labels).alias("service"),
        X.label_env(labels).alias("environment"),
        X.label_title(labels).alias("title"),
        F.col("_status").alias("status"),
        X.label_severity(labels).alias("severity"),
        "labels",
        "annotations",
        F.col("_starts").alias("starts_at"),
        F.col("_ends").alias("ends_at"),
        F.col("a.generatorURL").alias("generator_url"),
    )
    rejects = a.filter(F.col("_error").isNotNull()).select(*keep, "index", F.col("_error").alias("error"))
    return events, rejects
