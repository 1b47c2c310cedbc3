"""Text, field and fingerprint expressions on hand-made rows."""

import datetime as dt
import hashlib
import json
import re

from pyspark.sql import functions as F

from faultline.functions import fields as X
from faultline.functions import fingerprints as FP
from faultline.functions import text as S
from faultline.sources import logs as L

UTC = dt.timezone.utc


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_message_pattern(spark):
    cases = {
        "User 123 failed payment": "User {id} failed payment",
        "contact 192.168.0.10 failed": "contact {ip} failed",
        "id 550e8400-e29b-41d4-a716-446655440000 missing": "id {uuid} missing",
        "at 2026-09-01T12:00:00Z timeout": "at {timestamp} timeout",
        "digest deadbeefdeadbeefdeadbeefdeadbeef": "digest {hash}",
        "request_id=req-abc123xyz timeout": "{request_id} timeout",
        "at 2026-09-01 12:00:00 timeout": "at {id}-{id}-{id} {ip} timeout",
        "wait 15ms x": "wait 15ms x",
        "  a \t b  ": "a b",
        "café 12 ١٢": "café {id} {id}",
        " ": None,
    }
    assert column(spark, list(cases), S.message_pattern) == list(cases.values())


def test_fingerprint_equals_python_json(spark):
    texts = ["plain", "café ☃", 'quote " and \\', "tab\tend", "\U0001f600 x", "literal \\u00E9 text"]

    def expected(message):
        body = {"event_type": "LOG", "source": "s", "service": "", "severity": "HIGH", "normalized_message": message.strip()}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        return hashlib.sha256(text.encode()).hexdigest()

    got = column(
        spark, texts, lambda c: FP.event_fingerprint(F.lit("LOG"), F.lit("s"), F.lit(None).cast("string"), F.lit("HIGH"), c)
    )
    assert got == [expected(t) for t in texts]


def test_plain_lines(spark):
    lines = [
        "2026-09-01T12:00:00Z ERROR payments-api connection refused",
        "disk almost full, warning raised",
        "   no level here ",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    rows = L.parse_plain(df).orderBy("i").collect()
    assert rows[0]["timestamp"] == dt.datetime(2026, 9, 1, 12) and rows[0]["severity"] == "HIGH"
    assert rows[0]["message"] == "payments-api connection refused"
    assert (rows[1]["severity"], rows[1]["message"]) == ("MEDIUM", lines[1])
    assert (rows[2]["severity"], rows[2]["message"]) == (None, "no level here")


def test_key_value_line(spark):
    line = "timestamp=2026-09-01T12:00:00Z level=INFO service=payments-api host=node-1 request_id=req-99 message='payment ok'"
    row = L.parse_kv(spark.createDataFrame([(line,)], "line string")).first()
    assert (row["severity"], row["service"], row["host"], row["request_id"], row["message"]) == (
        "INFO",
        "payments-api",
        "node-1",
        "req-99",
        "payment ok",
    )


def test_files_in_every_format(spark, tmp_path):
    (tmp_path / "a.log").write_text("first line\n\n2026-09-01T12:00:00Z WARN second\n")
    (tmp_path / "b.jsonl").write_text('{"@timestamp": 1756728000, "msg": "x", "level": "error"}\n{"message": "ok", "time": "2026-09-01 10:00:00,250"}\nbad\n')
    (tmp_path / "c.json").write_text('[{"message": "a"}, 5, {"message": "b"}]')
    (tmp_path / "d.csv").write_text("timestamp,level,message\n2026-09-01T12:00:00Z,ERROR,one\n,,\n,INFO,two\n")
    (tmp_path / "e").write_text("level=error msg=m1\nlevel=info msg=m2\n")
    paths = [str(tmp_path / n) for n in ("a.log", "b.jsonl", "c.json", "d.csv", "e")]
    formats = {r["file"][-6:]: r["format"] for r in L.detect_formats(spark, paths).collect()}
    assert sorted(formats.values()) == ["csv", "json", "jsonl", "plain_text", "structured_text"]
    rows = L.scan_logs(spark, paths, lines=["inline"], line_numbers=True).collect()
    good = {(r["format"], r["line_number"], r["message"]) for r in rows if not r["corrupt"]}
    assert good == {
        ("plain_text", 1, "inline"),
        ("plain_text", 1, "first line"),
        ("plain_text", 3, "second"),
        ("jsonl", 1, "x"),
        ("jsonl", 2, "ok"),
        ("json", 1, "a"),
        ("json", 3, "b"),
        ("csv", 2, "one"),
        ("csv", 4, "two"),
        ("structured_text", 1, "m1"),
        ("structured_text", 2, "m2"),
    }
    times = {r["message"]: r["timestamp"] for r in rows}
    assert times["x"] == dt.datetime(2025, 9, 1, 12) and times["ok"] == dt.datetime(2026, 9, 1, 10, 0, 0, 250000)
    assert sum(r["corrupt"] for r in rows) == 2


def test_registered_format(spark, tmp_path):
    (tmp_path / "x.log").write_text("a|b\n")
    before = L._FORMATS["plain_text"]
    try:
        L.register_format("plain_text", lambda s, p, m, line_numbers=False: L.parse_plain(L.read_lines(s, p).withColumn("line", F.upper("line"))))
        assert L.scan_logs(spark, [str(tmp_path / "x.log")]).first()["message"] == "A|B"
    finally:
        L.register_format("plain_text", before)


def test_redaction(spark):
    texts = ["postgres://u:pw@h/db", "Bearer abc.def", "password = hunter2, next", "ghp_abc123", "nothing here", "key s3cr/et end"]
    got = column(spark, texts, lambda c: S.redact(c, ("s3cr/et",)))
    assert got == ["postgres://u:***@h/db", "Bearer ***", "password=***, next", "***", "nothing here", "key *** end"]
    nested = spark.sql("SELECT array(named_struct('k', 'token abc', 'n', 1)) AS a, map('x', 'pwd:1') AS m")
    row = S.redact_columns(nested, ["a", "m"]).first()
    assert row["a"][0]["k"] == "token ***" and row["m"]["x"] == "pwd=***"


def test_label_fields(spark):
    df = spark.sql("SELECT map('alertname', ' CPU ', 'job', 'api', 'severity', 'Warning') AS m")
    row = df.select(X.label_severity(F.col("m")), X.label_service(F.col("m")), X.label_env(F.col("m")), X.label_title(F.col("m"))).first()
    assert tuple(row) == ("HIGH", "api", "production", "CPU")


def test_benchmark_corpus_gives_thirty_fingerprints(spark):
    """Eight templates over 64 buckets, one of which hides its number from the digit rule."""
    words = ["a {n}", "b {n}", "c {n}", "d {n}", "e {n}", "f {n}", "g {n}", "took {n}ms"]
    rows = [(words[i % 64 % 8].format(n=i % 64), "ERROR" if i % 5 else "WARN") for i in range(640)]
    df = spark.createDataFrame(rows, "m string, level string")
    fp = FP.logical_fingerprint(F.lit("LOG"), F.lit("s"), X.parse_severity(F.col("level")), S.message_pattern(F.col("m")))
    assert df.select(fp.alias("f")).distinct().count() == 30
    assert len({re.sub(r"\b\d+\b", "#", m) + s for m, s in rows}) == 30
