"""Registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import configure
from faultline.llm import ann, collocations, cws, jaccard, lang_id, line_dedup, mixing, packing, resample, secrets, substring, suffix, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, len(lines) AS n, CAST('0x' || substr(md5(lines[i]), 1, 7) AS BIGINT) AS h
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
r AS (SELECT *, (h + 48271 * coalesce(lag(h) OVER w, 0)) % 2147483647 AS r FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, i = n OR (i > 1 AND r < lag(r) OVER w AND r < lead(r) OVER w) AS ends FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
b AS (SELECT doc_id, chunk, min(i) AS first, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY 1, 2),
g AS (SELECT doc_id, chunk FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS k FROM b WHERE lines > 1) WHERE k > 1)
SELECT d.doc_id, coalesce(max(c.n), 0) AS n_lines, coalesce(count(g.doc_id), 0) AS n_removed,
  CASE WHEN any_value(d.text) IS NOT NULL THEN sha256(coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE g.doc_id IS NULL), '')) END AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN g ON g.doc_id = c.doc_id AND g.chunk = c.chunk GROUP BY 1
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = lang_id.learn(lang_id.learn_fold(docs))
    p = lang_id.predict(docs.select("doc_id", "text"), model)
    return p.select("doc_id", lang_id.held_out().alias("held_out"), F.col("_lang.lang").alias("lang_pred"), "_lang.score", "_lang.margin", "_lang.rejected")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(_table(spark, sf_dir, "documents")).drop("removed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents")).drop("removed")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
g AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
t AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
m AS (SELECT t.doc_id, t.i, t.word, max(g.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i)
SELECT d.doc_id, CAST(len(any_value(d.words)) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) GROUP BY 1
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    rows = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH items AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM items GROUP BY 1),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
l AS (SELECT *, row_number() OVER o AS place, 3 * source_size / weight AS full_at,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
v AS (SELECT arg_min(level, place) AS level FROM l WHERE level <= full_at * (1 + 1e-12)),
t AS (SELECT l.source, source_size, least(CAST(3 * source_size AS DOUBLE), v.level * weight) AS target FROM l, v),
q AS (SELECT i.*, source_size, target, sum(size) OVER (PARTITION BY i.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM items i JOIN t ON i.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (source_size * epoch + cum) / target AS finish FROM (SELECT *, unnest([0, 1, 2]) AS epoch FROM q WHERE size > 0 AND target > 0)),
r AS (SELECT doc_id, key, sum(size) OVER (ORDER BY finish, source NULLS FIRST, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM c),
n AS (SELECT doc_id, key, count(*) AS copies FROM r WHERE upto <= (SELECT sum(size) FROM items) GROUP BY 1, 2)
SELECT q.doc_id, q.source, q.size, source_size, target, CAST(q.size * coalesce(copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON n.doc_id = q.doc_id AND n.key = q.key
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links FROM d
"""


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "place", "run", F.sha2("candidate", 256).alias("candidate_sha256"), *secrets.FEATURES, "score", "is_secret")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# CRC-32 by its polynomial: a byte's remainder, then one step for each byte of the UTF-8 text.
OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
both_ AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM both_),
f AS (SELECT side, id, unnest(words) AS f FROM w
  UNION ALL SELECT side, id, words[i] || ' ' || words[i + 1] FROM (SELECT side, id, words, unnest(range(1, len(words))) AS i FROM w)),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
k AS (SELECT h.f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM f JOIN k USING (f) GROUP BY 1),
a AS (SELECT CAST(coalesce(sum(s), 0) + 10000 AS DOUBLE) AS S, CAST(coalesce(sum(t), 0) + 10000 AS DOUBLE) AS T FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln((n.t + 1) * a.S / ((n.s + 1) * a.T))) AS BIGINT) AS gain FROM n, a),
v AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN k USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY 1),
d AS (SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT), 0) AS weight,
    CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN v USING (id) WHERE side = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS fit FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * fit // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, words FROM (SELECT lang, regexp_extract_all(unnest(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words,
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents))),
f AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(words) >= m) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(words[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(words[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c g ON g.lang = c.lang AND g.m > c.m AND 100 * g.a >= 80 * c.a AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))
SELECT c.lang, rank, c.phrase, a, l, r, n, score FROM (
  SELECT c.lang, c.phrase, a, l, r, score, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
  FROM c JOIN b ON b.lang = c.lang AND b.phrase = c.phrase ANTI JOIN o ON o.lang = c.lang AND o.phrase = c.phrase) c JOIN t ON t.lang = c.lang WHERE rank <= 2000
"""


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(configure(spark), sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_language_id, op3_suffix_dedup, op4_substring_dedup, op5_best_fit_packing,
    op6_mix_sources, op7_jaccard_join, op8_nearest_neighbours, op9_secret_scan, op10_fingerprints, op11_importance_resampling,
    op12_collocations, op13_exact_top_k, pipeline,
)}
SQL = {"op1_line_dedup": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op6_mix_sources": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_collocations": OP12_SQL, "op13_exact_top_k": OP13_SQL}
