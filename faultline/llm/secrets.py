"""Secret scans: candidates, and a random forest that removes false positives.

A candidate is a run of 16 or more key characters within a word; a word gives all
of its runs, told apart by ``run``. Its features are its length, its shares of
digits and capitals, how often the kind of character changes, distinct
characters, dictionary coverage, path and address signs, and the text before and
after it. That text reaches to the neighbouring runs of the word and takes them
in; before the first and after the last run it goes on in the neighbouring words.
So a word of many runs gives no more text than a few times its length. Dictionary
coverage is the share of its three-letter parts that are common in the words of
all documents.

The forest is trained on labelled findings, at most ``TRAIN_ROWS`` of a class,
those of least hash. It comes out as a SQL expression, so scoring is a
projection. ``known_findings`` labels candidates by published key formats and
plain non-secrets where no reviewed findings are at hand; the rest is unlabelled.

Defined cases: null and empty texts have no candidates. Without labels of both
kinds every candidate scores as labelled, or 0. Rows equal in id and text give
their findings once each. Extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import SPACE, once
from faultline.session import cut

LEAST = 16
RUN = r"[A-Za-z0-9+/_.\-]{%d,}=*" % LEAST
TRAIN_ROWS = 20_000
TREES, TREE_DEPTH = 20, 6
COMMON = 1e-5
DICTIONARY_WORD = 15

# Published key formats, and words that stand before keys.
KEY_FORMATS = (
    r"^AKIA[0-9A-Z]{16}$",
    r"^gh[pousr]_[A-Za-z0-9]{36,}$",
    r"^xox[abprs]-[A-Za-z0-9-]{10,}$",
    r"^sk_live_[A-Za-z0-9]{16,}$",
    r"^AIza[A-Za-z0-9_-]{35}$",
    r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+$",
)
DIGEST = r"(?i)^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
KEY_WORDS = r"(?i)(token|secret|passwd|password|pwd|api_?key|apikey|access_?key|private_?key|credential|bearer|auth)"
PLACEHOLDER = r"(?i)(example|sample|placeholder|dummy|xxxx|your[_-]|changeme|0000|1234567)"

FEATURES = ("length", "digits", "capitals", "changes", "variety", "coverage", "hex", "path", "address", "quoted", "assigned", "key_before", "key_near")


def candidates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, place (number of the word, from 0), run (number in the word, from 0), candidate, and the text around it.

    ``word`` is the part of the word between the neighbouring runs, ``ahead`` the text before
    the candidate from the run before on, ``before`` up to three words before the first run,
    ``after`` the word after the last run, or what stands up to the end of the next run.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).where(F.col("_t").rlike(r"[^\x20\x09-\x0D]{%d}" % LEAST))
    d = once(d, "_w", F.split(F.trim(F.regexp_replace("_t", SPACE, " ")), " ")).drop("_t")
    long = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.length(F.get("_w", i)) >= LEAST)
    d = once(d, "_at", long).select("doc_id", "_w", F.explode("_at").alias("place"))

    def word(back):
        return F.when(F.col("place") >= back, F.get("_w", F.col("place") - back)) if back > 0 else F.get("_w", F.col("place") - back)

    d = d.select(
        "doc_id", "place", word(0).alias("word"),
        F.concat_ws(" ", word(3), word(2), word(1)).alias("before"), F.coalesce(word(-1), F.lit("")).alias("after"),
    )
    d = once(d, "_runs", F.regexp_extract_all("word", F.lit(f"({RUN})"), 1)).where(F.size("_runs") > 0)
    d = once(d, "_gaps", F.split("word", RUN))  # one more than the runs

    def part(i):
        run, gap, empty = F.get("_runs", i), F.get("_gaps", i + 1), F.lit("")
        ahead = F.concat(F.coalesce(F.get("_runs", i - 1), empty), F.get("_gaps", i))
        after = F.when(i == F.size("_runs") - 1, F.col("after")).otherwise(F.concat(gap, F.get("_runs", i + 1)))
        before = F.when(i == 0, F.col("before")).otherwise(empty)
        return F.struct(i.alias("run"), F.concat(ahead, run, gap).alias("word"), ahead.alias("ahead"), before.alias("before"), after.alias("after"), run.alias("candidate"))

    parts = F.transform(F.sequence(F.lit(0), F.size("_runs") - 1), part)
    d = d.select("doc_id", "place", F.explode(parts).alias("_p")).select("doc_id", "place", "_p.*")
    return d.withColumn("candidate", F.regexp_replace("candidate", r"[.\-]+$", "")).where(F.length("candidate") >= LEAST)


def dictionary(docs: DataFrame, text_col="text") -> DataFrame:
    """Three-letter parts of the words of all documents, where they are ``COMMON`` or more of all parts."""
    words = docs.select(F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("w"))
    words = words.where((F.length("w") > 2) & (F.length("w") <= DICTIONARY_WORD)).groupBy("w").agg(F.count("*").alias("n"))
    parts = words.select("n", F.explode(_parts(F.col("w"))).alias("part")).groupBy("part").agg(F.sum("n").alias("n"))
    parts = cut(parts)
    total = parts.agg(F.sum("n")).first()[0] or 0
    return parts.where(F.col("n") >= total * COMMON).select("part")


def _parts(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, F.lit(3)))


def featured(found: DataFrame, common: DataFrame) -> DataFrame:
    """Add the features to candidates."""
    strings = found.select("candidate").distinct()
    parts = strings.select("candidate", F.explode(_parts(F.lower("candidate"))).alias("part"))
    known = parts.join(common.withColumn("_known", F.lit(1)), "part", "left")
    cover = known.groupBy(F.col("candidate").alias("_c")).agg((F.count("_known") / F.count("*")).alias("coverage"))
    d = found.join(cover, F.col("candidate") == F.col("_c")).drop("_c")
    c, n = F.col("candidate"), F.length("candidate")
    kinds = c
    for pattern, kind in ((r"[0-9]", "9"), (r"[A-Z]", "A"), (r"[a-z]", "a"), (r"[^9Aa]", "-")):
        kinds = F.regexp_replace(kinds, pattern, kind)
    ahead = F.col("ahead")
    flags = {
        "hex": c.rlike(r"(?i)^[0-9a-f]+$"),
        "path": c.rlike(r"/.*/|\.[a-z]{2,4}$"),
        "address": F.col("word").rlike(r"@|://|www\."),
        "quoted": ahead.rlike("[\"'`]$"),
        "assigned": ahead.rlike("[=:]") | F.col("before").rlike("[=:]$"),
        "key_before": ahead.rlike(KEY_WORDS) | F.col("before").rlike(KEY_WORDS),
        "key_near": F.col("after").rlike(KEY_WORDS),
    }
    shares = {
        "length": n.cast("double"),
        "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
        "capitals": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
    }
    return d.withColumns(shares | {k: v.cast("double") for k, v in flags.items()})


def known_findings(found: DataFrame) -> DataFrame:
    """Label candidates: 1 for keys by format, 0 for plain non-secrets, null where neither is sure."""
    c = F.col("candidate")
    key = F.lit(False)
    for pattern in KEY_FORMATS:
        key = key | c.rlike(pattern)
    key = key | (c.rlike(DIGEST) & (F.col("key_before") == 1) & (F.col("assigned") == 1))
    plain = c.rlike(r"^[A-Za-z]+$") | c.rlike(PLACEHOLDER) | (F.col("address") == 1) | (F.col("path") == 1) | c.rlike(r"^[0-9.]+$")
    return found.withColumn("label", F.when(key & ~c.rlike(PLACEHOLDER), 1.0).when(plain, 0.0))


def train(labelled: DataFrame, label="label") -> Column | None:
    """Fit a forest and return its score (0 to 1) as an expression over the features."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    d = labelled.select(F.col(label).alias("label"), *FEATURES, F.xxhash64("candidate", "before", "doc_id", "place", "run").alias("_h"))
    sample = None
    for value in (0.0, 1.0):  # the rows of least hash of a class
        part = d.where(F.col("label") == value).orderBy("_h").limit(TRAIN_ROWS).drop("_h")
        sample = part if sample is None else sample.unionByName(part)
    sample = cut(sample.coalesce(1))
    if sample.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, seed=7).fit(rows)
    trees = [F.expr(_tree_sql(tree)) for tree in _trees(model.toDebugString)]
    return sum(trees[1:], trees[0]) / len(trees)


def _trees(text: str) -> list[list[str]]:
    out: list[list[str]] = []
    for line in text.split("\n"):
        if re.match(r"\s*Tree \d+", line):
            out.append([])
        elif out and line.strip():
            out[-1].append(line.strip())
    return out


def _tree_sql(lines: list[str]) -> str:
    """Nested CASE of a printed tree: If / Else lines with a feature and threshold, Predict lines."""
    rows = iter(lines)

    def node() -> str:
        line = next(rows)
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])}D"
        feature, threshold = re.match(r"If \(feature (\d+) <= ([^)]+)\)", line).groups()
        low = node()
        next(rows)  # the Else line repeats the condition
        return f"CASE WHEN {FEATURES[int(feature)]} <= {float(threshold)!r}D THEN {low} ELSE {node()} END"

    return node()


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Every candidate with features, score and is_secret.

    ``findings``: reviewed candidates (doc_id, place, run, label) to learn from, else known formats.
    Without ``run`` they are of the first run of their words.
    """
    found = candidates(docs, id_col, text_col)
    d = cut(featured(found, dictionary(docs, text_col)))
    if findings is None:
        labelled = known_findings(d)
    else:
        run = F.col("run") if "run" in findings.columns else F.lit(0).alias("run")
        labelled = d.join(findings.select("doc_id", "place", run, "label"), ["doc_id", "place", "run"])
    score = train(labelled)
    if score is None:
        score = F.coalesce(F.col("label"), F.lit(0.0)) if findings is None else F.lit(0.0)
    base = labelled if findings is None else d
    out = base.withColumn("score", score).withColumn("is_secret", F.col("score") >= 0.5)
    return out.drop("label")
