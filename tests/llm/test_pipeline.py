"""The stages of the pipeline, as run() strings them together, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from faultline.llm import lang_id
from faultline.session import cut

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def without_repeated_lines(docs):
    chunks, first, kept = [], {}, {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        lines = r.text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        roll = [(h[i] + 48271 * (h[i - 1] if i else 0)) % 2147483647 for i in range(len(h))]
        begin = 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or (i and roll[i] < roll[i - 1] and roll[i] < roll[i + 1]):
                chunks.append((r.doc_id, lines[begin : i + 1]))
                begin = i + 1
    out, lost = defaultdict(list), Counter()
    for i, lines in chunks:
        body = "\n".join(lines)
        if len(lines) > 1 and body in first:
            lost[i] += len(lines)
        else:
            first.setdefault(body, i)
            out[i] += lines
    return {r.doc_id: "\n".join(out[r.doc_id]) for r in docs if not lost[r.doc_id] or out[r.doc_id]}


def least_of_classes(docs):
    sets, holders = {}, defaultdict(list)
    for r in docs:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for g in sets[r.doc_id]:
            holders[g].append(r.doc_id)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j > i).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {top(i) for i in sets}


def mixed(docs):
    by_source = defaultdict(list)
    for r in docs:
        key = int(hashlib.md5(f"{r.doc_id}:{r.text}".encode()).hexdigest()[:15], 16)
        by_source[r.source].append((key, r.doc_id, len(words(r.text))))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for *_, n in by_source[s]) for s in names}
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(size.values())
    order, before = sorted(names, key=lambda s: (3 * size[s] / weight[s], s is None, s or "")), 0
    for k, s in enumerate(order):
        level = (total - before) / sum(weight[x] for x in order[k:])
        if level <= 3 * size[s] / weight[s] * (1 + 1e-12):
            break
        before += 3 * size[s]
    copies = []
    for s in names:
        target, upto = min(3.0 * size[s], level * weight[s]), 0
        for key, i, n in sorted(by_source[s]):
            upto += n
            copies += [((size[s] * epoch + upto) / target, s is not None, s or "", key, i, epoch, n) for epoch in range(3) if n]
    taken, upto = Counter(), 0
    for *_, i, _, n in sorted(copies):
        upto += n
        taken[i] += upto <= total
    return +taken


def test_every_stage_is_plain_python(spark, monkeypatch, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    rows = base.collect()
    clean = [r for r in rows if len(words(r.text)) > 50]
    lined = [r for r in clean if r.text.count("\n") > 5][:3]

    def row(i, text, source="web"):
        return (i, text, "en", source, len(text or ""))

    extra = [row(10**6, None), row(10**6 + 1, ""), row(10**6 + 2, "12 34 !?"), row(10**6 + 3, "a"), row(10**6 + 4, clean[0].text, None)]
    extra += [row(10**6 + 10 + k, r.text) for k, r in enumerate(clean[:5])]
    extra += [row(10**6 + 20 + k, r.text + f" another{k}") for k, r in enumerate(clean[5:10])]
    extra += [row(10**6 + 30 + k, clean[20 + k].text + "\n" + r.text) for k, r in enumerate(lined)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows] + extra, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def recorded(name, stage):
        def run(spark, given, sf_dir):
            out = cut(stage(spark, given, sf_dir))
            seen[name] = (given.collect(), out.collect(), given)
            return out

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, recorded(n, s)) for n, s in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()

    given, out, table = seen["language_id"]
    verdict = lang_id.predict(table, lang_id.learn(table)).collect()
    told = {r.doc_id for r in verdict if re.search(r"[^\W\d_]", r.text or "") and r._lang.margin >= lang_id.MIN_MARGIN}
    assert {r.doc_id for r in out} == told and len(out) == len(told)
    assert not told & {10**6, 10**6 + 1, 10**6 + 2}
    text = {r.doc_id: r for r in given}
    assert all(r == text[r.doc_id] for r in out)

    given, out, _ = seen["line_dedup"]
    want = without_repeated_lines(given)
    assert {r.doc_id: (r.text, r.n_chars) for r in out} == {i: (t, len(t)) for i, t in want.items()} and len(out) == len(want)
    assert len(want) < len(given)

    given, out, _ = seen["near_duplicates"]
    least = least_of_classes(given)
    assert {r.doc_id: r for r in out} == {r.doc_id: r for r in given if r.doc_id in least} and len(out) == len(least)
    assert len(least) < len(given)

    given, out, _ = seen["mixing"]
    assert Counter(r.doc_id for r in out) == mixed(given)
    text = {r.doc_id: r for r in given}
    assert all(r == text[r.doc_id] for r in out)

    given = seen["packing"][0]
    per, bins = defaultdict(int), defaultdict(list)
    for r in last:
        per[(r.doc_id, r.copy)] += r.words
        if r.bin is not None:
            bins[r.bin].append(r)
    assert Counter((i, n) for (i, _), n in per.items()) == Counter((r.doc_id, len(words(r.text))) for r in given)
    for members in bins.values():
        assert sum(r.words for r in members) == members[0].bin_words
        assert len({r.doc_id for r in members}) == len(members)
