"""Operators against brute force, on the small tables and on odd rows."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ann, induced, jaccard, lang_id, line_dedup, mixing, packing, secrets, substring, suffix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key string, _text string, node long"
LONG = " ".join(f"w{k}" for k in range(3000))
ODD = [
    (None, "a b c d e f", "en", None, 1, "x", "x", "x", 1),
    (1, None, None, "s", None, None, None, None, None),
    (2, "", "en", "s", 0, "", "", "", 0),
    (3, LONG, "en", "s", 1, "x", "x", "x", 1),
    (4, LONG, "de", "t", 1, "x", "x", "x", 1),
    (4, LONG, "de", "t", 1, "x", "x", "x", 1),
    (4, "other\ntext\nof\nlines", "de", "t", 1, "x", "x", "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    for trial in range(60):
        parts = [bytes(rng.integers(97, 99 + trial % 3, rng.integers(1, 40)).astype(np.uint8)) for _ in range(5)]
        parts += parts[: trial % 3] + [b"a" * (trial % 9 + 1)]
        begin = np.cumsum([0] + [len(p) + 1 for p in parts])
        text = np.zeros(begin[-1], dtype=np.int16)
        for b, p in zip(begin, parts):
            text[b : b + len(p)] = np.frombuffer(p, dtype=np.uint8).astype(np.int16) + 1
        got = [(int(i), int(v)) for run in induced.sorted_suffixes(text) for i, v in zip(*run) if text[i] > 0]

        def suffix_at(i):
            return list(text[i : begin[np.searchsorted(begin, i, "right")] - 1])

        assert sorted(i for i, _ in got) == [i for i in range(len(text)) if text[i] > 0]
        for (a, _), (b, v) in zip(got, got[1:]):
            x, y = suffix_at(a), suffix_at(b)
            assert x <= y
            same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert v == same


def test_queues_spill_and_return_in_order():
    q = induced.Queues(spill=64)
    for k in range(20):
        q.push(k % 3, np.arange(k, k + 4), np.arange(k, k + 4) + 100)
    for byte in range(3):
        position, source = q.pop(byte)
        assert list(position) == [x for k in range(byte, 20, 3) for x in range(k, k + 4)]
        assert list(source - 100) == list(position)


def check_suffix_dedup(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = Counter(b[i : i + 400] for _, b in rows for i in range(len(b) - 399))
    got = {r.doc_id: r for r in suffix.suffix_dedup(docs).collect()}
    for i, b in rows:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest()
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, kept)


def test_suffix_dedup_is_brute_force(docs):
    check_suffix_dedup(docs)


def test_suffix_shards_stay_bounded_on_common_passages(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BYTES", 6000)
    rng = np.random.default_rng(5)

    def noise(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    lines, licence, body = [noise(90) for _ in range(6)], noise(700), noise(450)
    texts = [noise(500) + lines[k % 6] + noise(500) for k in range(180)]
    texts += [noise(k % 40) + licence + noise(k % 50) for k in range(80)]
    texts += [noise(100) + lines[k % 6] + body + noise(100) for k in range(12)] + [noise(300) + licence[:395] + noise(300) for _ in range(40)]
    texts += [body[:380] * 3 + noise(k) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    check_suffix_dedup(docs)
    _, segments = suffix._settled(suffix.identified(docs, "doc_id", "text"))
    sizes = [r[0] for r in segments.groupBy("anchor").agg(F.sum(F.length("body"))).select("sum(length(body))").collect()]
    assert sizes and max(sizes) <= 6000
    monkeypatch.setattr(suffix, "HOT_BYTES", 1 << 30)
    _, whole = suffix._settled(suffix.identified(docs, "doc_id", "text"))
    assert whole.groupBy("anchor").agg(F.sum(F.length("body")).alias("n")).where("n > 6000").count() > 0


def test_substring_dedup_is_brute_force(docs):
    got, seen = {r.doc_id: r for r in substring.substring_dedup(docs).collect()}, set()
    for i, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("small,block", [(64, 1024), (3, 2)])
def test_jaccard_is_brute_force(docs, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets, holders = {}, defaultdict(list)
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for g in sets[r.doc_id]:
            holders[g].append(r.doc_id)
    links, parent = Counter(), {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j > i).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.report(docs).collect()}
    assert got == {i: (top(i), links[i]) for i in sets}


def test_packing_keeps_all_words_and_no_conflict(docs):
    twice = docs.unionByName(docs.where("doc_id % 5 = 0"))
    rows = packing.pack(twice, capacity=512, per_source=2).collect()
    want = Counter(len(words(r.text)) for r in twice.collect())
    per, bins = Counter(), defaultdict(list)
    for r in rows:
        per[(r.doc_id, r.copy)] += r.words
        if r.bin is not None:
            bins[r.bin].append(r)
    assert Counter(per.values()) == want
    text = {r.doc_id: " ".join(words(r.text)) for r in docs.collect()}
    for members in bins.values():
        assert sum(r.words for r in members) == members[0].bin_words <= 512
        assert len({text[r.doc_id] for r in members}) == len(members)
        assert max(Counter(r.source for r in members).values()) <= 2
    full = sum(r.words for r in rows) / (512 * len(bins))
    assert full > 0.9


def test_language_of_held_out_documents(docs):
    model = lang_id.learn(lang_id.learn_fold(docs))
    out = lang_id.predict(docs, model).where(lang_id.held_out()).select("lang", "_lang").collect()
    assert sum(r.lang == r._lang.lang for r in out) / len(out) > 0.95
    assert all(0 <= r._lang.score <= 1 for r in out)


def test_neighbours_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    e = e.unionByName(spark.createDataFrame([(10**6, None, 1), (10**6 + 20, [0.0] * 64, 1), (10**6 + 40, [float("nan")] * 64, 1)], e.schema))
    got = defaultdict(list)
    for r in ann.nearest(e, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    p = e.where("vec_id < 1000000").toPandas()
    x, ids = np.stack(p.embedding.to_numpy()).astype(float), p.vec_id.to_numpy()
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != k][:20]
        assert len(got[ids[k]]) == 20 and all(abs(sc - s[ids == i][0]) < 1e-12 for i, sc in got[ids[k]])
        hit += len(set(best) & {i for i, _ in got[ids[k]]})
        total += 20
    assert hit / total >= 0.9 and len(got) == total // 20


def test_neighbours_of_all_regions_are_brute_force(spark, monkeypatch):
    """With every list taken nothing is lost to the floor: ties, repeated vectors and repeated rows included."""
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    monkeypatch.setattr(ann, "REGION", 2)
    monkeypatch.setattr(ann, "VECTORS", 24)
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (500, 4))
    x[:, 0] += 5  # none is zero
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, prune=1e9).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, len(x), 20):
        score = x @ x[q]
        best = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [got[q][k] for k in range(1, 6)] == [(i, float(score[i])) for i in best]


def test_secrets_find_tokens(docs, spark):
    planted = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(10**6 + k, f'some words token = "{hashlib.sha1(str(k).encode()).hexdigest()}" more') for k in range(40)], "doc_id long, text string")
    )
    got = {r.doc_id for r in secrets.scan(planted).where("is_secret").collect()}
    assert {10**6 + k for k in range(40)} <= got
    clean = {r.doc_id for r in docs.where(~F.col("text").rlike('(?i)(token|key|secret)')).collect()}
    assert not clean & got


def test_secrets_take_every_run_of_a_word(docs, spark):
    def key(k, n=36):
        return base64.b64encode(hashlib.sha512(str(k).encode()).digest()).decode().replace("+", "x").replace("/", "y")[:n]

    forms = {}
    for k in range(40):
        hub, aws = "ghp_" + key(k), "AKIA" + hashlib.sha1(str(k).encode()).hexdigest()[:16].upper()
        forms[10**6 + 4 * k] = (f"aws_secret_access_key={key(k, 40)}", [key(k, 40)])
        forms[10**6 + 4 * k + 1] = (f"https://host.invalid/long/way/items?token={hub}", [hub])
        forms[10**6 + 4 * k + 2] = ('{"github_token_value":"%s"}' % hub, [hub])
        forms[10**6 + 4 * k + 3] = ('{"a":"%s","b":"%s"}' % (aws, hub), [aws, hub])
    planted = spark.createDataFrame([(i, f"some words {word} more") for i, (word, _) in forms.items()], "doc_id long, text string")
    got = secrets.candidates(planted).collect()
    for i, (word, keys) in forms.items():
        runs = sorted((r.run, r.candidate) for r in got if r.doc_id == i)
        assert [k for _, k in runs] == re.findall(r"[A-Za-z0-9+/_.-]{16,}=*", word)
        assert [n for n, _ in runs] == list(range(len(runs))) and set(keys) <= {k for _, k in runs}
        for r in got:
            if r.doc_id == i:
                assert r.place == 2 and r.ahead + r.candidate in word and r.word in word
    scored = secrets.scan(docs.select("doc_id", "text").unionByName(planted)).where("is_secret and doc_id >= 1000000")
    told = {(r.doc_id, r.candidate) for r in scored.collect()}
    assert {(i, k) for i, (_, keys) in forms.items() for k in keys if k.startswith(("ghp_", "AKIA"))} <= told
    # reviewed findings are of single runs
    found = secrets.candidates(planted).where("doc_id % 4 = 3").select("doc_id", "place", "run", F.col("run").cast("double").alias("label"))
    learned = {(r.run, r.is_secret) for r in secrets.scan(planted, found).where("doc_id % 4 = 3").collect()}
    assert learned == {(0, False), (1, True)}


def test_secrets_text_around_many_runs_stays_linear(spark):
    row = ",".join(f'"{hashlib.sha1(str(k).encode()).hexdigest()}"' for k in range(2000))
    got = secrets.candidates(spark.createDataFrame([(1, row + " " + row)], "doc_id long, text string"))
    sizes = got.agg(F.count("*"), F.sum(F.length("word") + F.length("before") + F.length("after") + F.length("ahead"))).first()
    assert sizes[0] == 4000 and sizes[1] < 20 * len(row)


def test_odd_rows_and_empty_tables(odd, spark):
    none = spark.createDataFrame([], SCHEMA)
    runs = {
        "lines": (lambda d: line_dedup.line_dedup(d), 7),
        "mix": (lambda d: mixing.mix_plan(d), 6),
        "pack": (lambda d: packing.pack(d).where("piece = 0"), 7),
        "substring": (lambda d: substring.substring_dedup(d), 6),
        "suffix": (lambda d: suffix.suffix_dedup(d), 6),
        "jaccard": (lambda d: jaccard.report(d), 6),
        "one": (lambda d: jaccard.one_of_each(d), 5),
        "language": (lambda d: lang_id.predict(d, {}), 7),
        "secrets": (lambda d: secrets.scan(d), 0),
    }
    for name, (run, rows) in runs.items():
        assert run(odd).count() == rows, name
        assert run(none).count() == 0, name
