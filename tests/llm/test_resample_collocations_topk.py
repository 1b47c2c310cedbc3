"""Resampling, collocations and exact search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import compare, connection

from faultline.llm import collocations, queries, resample, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score string, k string, phrase string, prefix string"
BIG = " ".join(f"Wort{k % 977}, das" for k in range(400_000))  # above 5 MiB, longer than a stretch
ODD = [
    (1, "The cat sat. The cat ran; the CAT sat on the mat " * 3, "en", "s", 1, "x", "x", "x", "x"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, "", "", "", ""),
    (3, "the cat sat\tthe cat\x0bsat on on on on", "und", "s", 0, "", "", "", ""),
    (4, "é à the-cat é à 12 x" * 9, None, "s", 0, "", "", "", ""),
    (5, BIG, "de", "t", 1, "x", "x", "x", "x"),
    (None, "der Hund und der Hund und die Katze " * 8, "de", "t", 1, "x", "x", "x", "x"),
    (7, "der Hund und der Hund und die Katze " * 8, "de", "t", 1, "x", "x", "x", "x"),
    (7, "der Hund und der Hund und die Katze " * 8, "de", "t", 1, "x", "x", "x", "x"),
    (8, " \t\n.,;", "de", "t", 1, "x", "x", "x", "x"),
    (9, "\x00a\x7fB", "en\nx", "t", 1, "x", "x", "x", "x"),
]
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_collocations", "op13_exact_top_k"])
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, note


# --- resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def plain_resample(rows, target):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    own, aim = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for doc_id, x in rows:
        n, fs = features(x)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * own / ((s[b] + 1) * aim))) for b in map(bucket, fs))
        weight = total // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_resampling_of_odd_rows(spark, odd):
    more = spark.createDataFrame([(k, f"der hund {k} " * 12) for k in range(20, 60)], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    target = spark.createDataFrame([("der Hund 33 und 41",), (None,), ("x",)], "text string")
    got = [tuple(r) for r in resample.resample(docs, target).collect()]
    want = plain_resample([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], ["der Hund 33 und 41", None, "x"])
    assert in_order(got) == in_order(want)
    assert sum(r[4] is not None for r in got) == 11
    nothing = resample.resample(docs.limit(0), target.limit(0))
    assert nothing.columns == ["doc_id", "n_features", "weight", "score", "rank"] and nothing.collect() == []


def test_hundreds_of_equal_rows_share_ranks(spark):
    docs = spark.range(500).selectExpr("id % 2 as doc_id", "repeat('a b ', 15) as text")
    got = [r for r in resample.resample(docs, docs.limit(0)).collect()]
    assert len(got) == 500 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 126))


def test_hashes_are_xxhash64():
    import xxhash

    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8).tobytes()
    start = np.array([k * 29 % 4900 for k in range(3000)])
    end = start + np.array([k % 90 for k in range(3000)])
    got = resample.hashes(data, start, end)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(start, end)]


def test_interning_compares_bytes():
    rng = random.Random(5)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 4))) for _ in range(400)]
    data = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    table = resample.Interned(data, start, end, 50, hashed=lambda _, a, b: np.uint64(2**64 - 1) - ((b - a) % 2).astype(np.uint64))  # nearly all keys collide
    want = Counter(words)
    got = {words[int(np.flatnonzero(table.slot == s)[0])]: int(table.count[s]) for s in table.used}
    assert got == want
    assert [int(table.bucket[s]) for s in table.slot] == [zlib.crc32(w) % 50 for w in words]


def test_stretches_count_each_ngram_once(monkeypatch):
    monkeypatch.setattr(resample, "STRETCH", 40)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abZ é-", weights=[4, 4, 2, 5, 1, 1], k=n)) for n in (0, 3, 30, 39, 40, 41, 200, 900, 5)]
    texts += [" " * 300, "x" * 300, " " * 90 + "a b", "a" + " " * 100 + "b", None]
    column = pa.array(["skipped", *texts]).slice(1)
    seen, words = defaultdict(int), defaultdict(int)
    for table, rows, word_rows in resample._occurrences(column, 10000):
        for row, s in zip(rows, table.slot):
            seen[int(row), int(table.bucket[s])] += 1
        for row in word_rows:
            words[int(row)] += 1
    want = Counter((row, bucket(f)) for row, x in enumerate(texts) for f in features(x)[1])
    assert seen == want
    assert words == {row: features(x)[0] for row, x in enumerate(texts) if features(x)[0]}


# --- collocations


def pieces(text):
    for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
        yield re.findall(r"[^\x20\x09]+", p)


def plain_collocations(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = []
        frequent = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        covered = set()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= 80 * c[p[i : i + m]]:
                        covered.add(p[i : i + m])
        for p, a in frequent.items():
            if p not in covered:
                score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("top", [2000, 3])
def test_collocations_of_odd_rows(spark, odd, top):
    got = sorted(tuple(r) for r in collocations.collocations(odd, least=4, top=top).collect())
    want = plain_collocations([(r[2], r[1]) for r in ODD], 4, top)
    assert len(want) >= 8 and got == want
    assert collocations.collocations(odd.limit(0)).collect() == []


@pytest.mark.parametrize("collide", [False, True])
def test_stretches_count_every_phrase_once(monkeypatch, collide):
    monkeypatch.setattr(collocations, "STRETCH", 30)
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "_known", lambda h, bits: np.ones(len(h), dtype=bool))
    if collide:  # hashes of two bits
        real = collocations.Words.hashes
        monkeypatch.setattr(collocations.Words, "hashes", lambda self, *a: real(self, *a) & np.uint64(3))
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "cc", "x,", "d\t"], k=k)) for k in (0, 1, 5, 40, 41, 42, 43, 90)] + ["y" * 90 + " a b a", ", ; " * 30]
    langs = [rng.choice([b"l", b"m"]) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array([t.encode() for t in texts])], names=["lang", "text"])

    class Sent:
        value = (None, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))

    for depth in range(4):
        got = Counter()
        for b in collocations._count_stripes(depth, Sent)(iter([batch])):
            for r in b.to_pylist():
                words = r["next"].split(b"\n")[:-1]
                assert len(words) == len(r["n"])
                for w, c in zip(words, r["n"]):
                    got[r["lang"], r["prefix"] + b" " * bool(depth) + w] += c
        want = Counter((lang, " ".join(w[i : i + depth + 1]).encode()) for lang, t in zip(langs, texts) for w in pieces(t) for i in range(len(w) - depth))
        assert got == want


def test_frequent_prefixes_are_dealt_by_the_next_word():
    text = (b"a " + b" a ".join(b"w%d" % k for k in range(300))) * 3
    batch = pa.RecordBatch.from_arrays([pa.array([b"l"]), pa.array([text])], names=["lang", "text"])

    class Sent:
        value = (np.full(collocations.FILTER_BITS // 64, 2**64 - 1, dtype=np.uint64), (np.array([collocations.hash_of(b"l", b"a")], dtype=np.uint64), np.array([7])))

    (out,) = collocations._count_stripes(1, Sent)(iter([batch]))
    of_a = [r for r in out.to_pylist() if r["prefix"] == b"a"]
    assert {r["part"] for r in of_a} == set(range(7)) and len(of_a) == 7
    assert all(r["part"] == 0 for r in out.to_pylist() if r["prefix"] != b"a")


def test_merge_of_stripes_that_cross_batches():
    rng = random.Random(3)
    rows = sorted(((rng.choice([b"k", b"l"]), rng.choice([b"p", b"q", b""]), rng.randint(0, 1), rng.sample([b"x", b"y", b"zz", b"\x00"], rng.randint(1, 4))) for _ in range(60)), key=lambda r: r[:3])
    rows = [(*r[:3], b"".join(w + b"\n" for w in r[3]), [rng.randint(1, 9) for _ in r[3]]) for r in rows]
    schema = pa.schema([("lang", pa.binary()), ("prefix", pa.binary()), ("part", pa.int32()), ("next", pa.binary()), ("n", pa.list_(pa.int64()))])
    want = Counter()
    for lang, p, s, words, n in rows:
        for w, c in zip(words.split(b"\n"), n):
            want[lang, p, s, w] += c
    for size in (1, 4, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), schema.types)], schema=schema) for i in range(0, 60, size)]
        got = [tuple(r.values()) for b in collocations._merge_stripes(20, True)(iter(batches)) for r in b.to_pylist()]
        assert Counter(r for r in got if r[2] is not None) == Counter((lang, p, w, n) for (lang, p, _, w), n in want.items() if n >= 20)
        sums = Counter()
        for (lang, p, s, _), n in want.items():
            sums[lang, p, s] += n
        assert Counter(r for r in got if r[2] is None) == Counter((lang, p, None, n) for (lang, p, _), n in sums.items())


def test_filter_bits_are_those_of_the_tasks(spark):
    phrases = [f"wort {k} é".encode() for k in range(300)]
    bits = collocations._filter_of(spark.createDataFrame([(b"en", p) for p in phrases], "lang binary, phrase binary"), np.zeros(collocations.FILTER_BITS // 64, dtype=np.uint64))

    def known(lang, phrases):
        return collocations._known(np.array([collocations.hash_of(lang, p) for p in phrases], dtype=np.uint64), bits)

    assert known(b"en", phrases).all()
    assert known(b"en", [p + b"x" for p in phrases]).sum() < 3 and known(b"de", phrases).sum() < 3


# --- exact search


def plain_top_k(rows, every, k):
    rows = [(i, np.floor(1024 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows]
    rows = list({(i, tuple(v)): (i, v) for i, v in rows}.values())
    out = []
    for i, q in rows:
        if i % every == 0:
            near = sorted((-int(q @ v), j) for j, v in rows if not (j == i and (v == q).all()))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, annulus int, k1 string, floor string, id string, vec string")


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 6))
    x = (middles[rng.integers(0, 12, 3500)] + spread * rng.normal(size=(3500, 6))) * rng.choice([0.3, 1, 4], (3500, 1))
    x = np.round(x, 2).astype(np.float32)
    x[:700] = x[0]  # a large group of copies
    x[700:720] = 0
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    got = topk.top_k(vectors(spark, [(i, v, 1, "x", "x", "x", "x") for i, v in rows]), topk.F.col("vec_id") % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(rows, 100, 10)


def test_top_k_of_odd_rows(spark):
    good = [(100, [1.0, 2.0]), (100, [2.0, 1.0]), (200, [-0.0, 0.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [-1.0, 0.0001])]
    bad = [(None, [1.0, 1.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (8, []), (9, [1.0] * 3), (400, [3e9, 1.0])]
    got = topk.top_k(vectors(spark, [(i, v, 1, "x", "x", "x", "x") for i, v in good + bad]), topk.F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(good, 100, 10)
    nothing = topk.top_k(vectors(spark, [(5, None, 1, "x", "x", "x", "x")]), topk.F.col("vec_id") % 100 == 0)
    assert nothing.columns == got.columns and nothing.collect() == []


def test_scores_beyond_exact_doubles(spark):
    rows = [(k, [2.0**20 + k, 2.0**20 - 3.0 * k]) for k in range(30)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(t, topk.F.col("vec_id") % 10 == 0).collect()) == plain_top_k(rows, 10, 10)


def test_bounds_stop_the_search():
    rng = np.random.default_rng(0)
    x = np.round(1024 * (rng.normal(size=(20, 4))[rng.integers(0, 20, 20000)] + 0.01 * rng.normal(size=(20000, 4)))).astype(np.int64)
    index = topk.Pivots(x, int((x**2).sum(1).max()), len(x))
    annulus, r = index.keys(x)
    number = np.unique(annulus)
    low, high = (np.array([f(r[annulus == a]) for a in number]) for f in (np.min, np.max))

    class Held:
        def __init__(self, value):
            self.value = value

    q = x[:50]
    least = np.sort(q @ x.T, axis=1)[:, -11]
    batch = pa.RecordBatch.from_arrays([pa.array(q.tolist(), pa.list_(pa.int64())), pa.array(least.astype(float))], names=["vec", "floor"])
    (out,) = topk._take(Held(index), Held((number, low, high)), 0, None)(iter([batch]))
    taken = out["annuli"].to_pylist()
    assert np.mean([len(t) for t in taken]) < len(number) / 2  # the bounds prune
    for row, t in enumerate(taken):  # and lose nothing
        assert set(annulus[(q[row] @ x.T) >= least[row]]) <= set(t)
