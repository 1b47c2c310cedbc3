"""Validation of mixed events reads each text once."""

import json

from faultline.sources import events as EVT


def test_checks_parse_each_text_once(spark):
    good = {"event_type": "LOG", "timestamp": "2026-01-01T00:00:00Z", "source": "a", "source_type": "b", "raw_data": {"k": 1}, "message": "m"}
    texts = [json.dumps(good), json.dumps(good | {"extra": 1}), json.dumps(good | {"raw_data": None}), "not json", "[1]", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "index long, payload string")
    accepted, rejects = EVT.parse_events(df)
    assert [(r["index"], r["message"], r["raw_data"]) for r in accepted.collect()] == [(0, "m", {"k": "1"})]
    errors = {r["index"]: r["errors"] for r in rejects.collect()}
    assert sorted(errors) == [1, 2, 3, 4, 5]
    assert errors[1] == ["unknown field"] and errors[2] == ["missing raw_data"]
    assert all(errors[i][0] == "not a JSON object" and "bad timestamp" in errors[i] for i in (3, 4, 5))
    for rows in (accepted.select("index", "timestamp"), rejects.select("index")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1
