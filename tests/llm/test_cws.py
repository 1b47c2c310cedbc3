import hashlib
import re
from collections import Counter

from faultline.llm import cws

SF = "/root/testdata/sf0.001"


def edited(texts):
    """Texts by descending id, each with the last third taken from the start of the next."""
    out = []
    for k, t in enumerate(texts):
        third = len(t) // 3
        out.append(t[: len(t) - third] + texts[(k + 1) % len(texts)][:third])
    return out


def jaccard(a, b):
    x, y = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def test_edited_texts_and_likeness(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in cws.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    changed = edited([t for _, t in rows])
    error = []
    for k, ((i, t), e) in enumerate(zip(rows, changed)):
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        error.append(got[i].near_edited - jaccard(t, e))
        after = rows[(k + 1) % len(rows)]
        assert (got[i].near_next == 1.0) == (got[i].fingerprint == got[after[0]].fingerprint)
    assert abs(sum(error) / len(error)) < 0.02  # unbiased
    assert sum(abs(x) for x in error) / len(error) < 0.11  # sd of 32 samples is 0.088 at most
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_nulls_ties_and_empty_tables(spark):
    schema = "doc_id long, text string, _text string, _range long"
    rows = [(None, "a b c", "x", 1), (3, None, "x", 1), (3, "é" * 7, None, 1), (9000, "", "x", None), (9000, "", "x", None)]
    got = cws.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 3, 0), (False, 3, 7), (False, 9000, 0), (False, 9000, 0), (True, 0, 5)]
    empty = [r for r in got if r.n_chars == 0 and r.doc_id == 9000]
    assert empty[0].fingerprint == empty[1].fingerprint and max(r.near_next for r in empty) == 1.0
    assert cws.fingerprints(spark.createDataFrame([], schema)).collect() == []
