"""Document fingerprints by consistent weighted sampling.

A text is the bag of its words, the weight of a word its count. Sample ``k`` of
a text is the word and quantized weight that minimize ``c / (y e^r)`` with
``r, c ~ Gamma(2, 1)``, ``b ~ U(0, 1)``, ``t = floor(ln w / r + b)`` and
``y = e^(r (t - b))``; the three variates depend on the word and ``k`` alone
(Ioffe, ICDM 2010). Two texts agree in a sample with the probability of their
generalised Jaccard similarity, sum of minima over sum of maxima of counts.
The minimum itself stands for its word and weight: equal minima, equal sample.

The edited text of a document needs its successor in id order. Documents are
dealt into ranges of ``RANGE_IDS`` ids, each with a copy of the first document
of the range after, so the order is never sorted in one task, and all later
steps stay in the partitions of that one shuffle.

Defined cases: null text is empty; empty texts share one fingerprint, which is
like itself (1.0) and no other (0.0). Equal ids are ordered by hash of the
text; rows without an id come last, by hash of the text. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import SPACE, text_or_empty

SAMPLES = 32
RANGE_IDS_LOG2 = 10
RANGE = ("_none", "_range")


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the place of their range, descending by id."""
    text = text_or_empty(text_col)
    d = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    none, at = F.col("_id").isNull(), F.bitwise_not(F.col("_id"))
    tie = F.xxhash64("_text")
    d = d.select(none.alias("_none"), F.coalesce(at, tie).alias("_at"), tie.alias("_tie"), "_text")
    width = F.when(F.col("_none"), F.shiftright("_at", 50)).otherwise(F.shiftright("_at", RANGE_IDS_LOG2))
    return d.withColumn("_range", width)


def _with_successor_ranges(d: DataFrame) -> DataFrame:
    """Add the first row of each range, as a guest, to the range before it; the first range follows the last.

    First rows come with their texts from an aggregation, which combines before its shuffle.
    """
    place = F.struct("_at", "_tie")
    firsts = d.groupBy(*RANGE).agg(F.min(place).alias("p"), F.min_by("_text", place).alias("_text"))
    order = Window.orderBy(*RANGE)
    back = F.struct(*RANGE)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the order of ranges is taken without the texts
    to = firsts.select(*RANGE, F.coalesce(F.lag(back).over(order), F.last(back).over(whole)).alias("_to"))
    guests = firsts.join(to, list(RANGE)).select(
        F.lit(True).alias("_guest"), "_to._none", "_to._range", "p._at", "p._tie", "_text"
    )
    return d.select(F.lit(False).alias("_guest"), *RANGE, "_at", "_tie", "_text").unionByName(guests)


def _sample(k: int) -> list[str]:
    """SQL of sample k of a word's two counts, the minimized quantity in logarithms."""
    two = "(shiftrightunsigned({h}, 32) + 0.5D) * (({h} & 4294967295L) + 0.5D) * 5.421010862427522E-20D"
    r = "(-ln(" + two.format(h=f"xxhash64(_word, {3 * k})") + "))"
    c = "ln(-ln(" + two.format(h=f"xxhash64(_word, {3 * k + 1})") + "))"
    b = f"((shiftrightunsigned(xxhash64(_word, {3 * k + 2}), 11) + 0.5D) * 1.1102230246251565E-16D)"
    return [f"{c} - {r} * (floor({w} / {r} + {b}) - {b} + 1)" for w in ("_own", "_edited")]


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", samples: int = SAMPLES) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    placed = _with_successor_ranges(_ordered(docs, id_col, text_col))
    w = Window.partitionBy(*RANGE).orderBy("_guest", "_at", "_tie")
    n = F.char_length("_text")
    d = placed.repartition(*RANGE).select(*placed.columns, F.row_number().over(w).alias("_row"), F.lead("_text").over(w).alias("_next"))
    third = F.floor(n / 3).cast("int")
    d = d.withColumn("_changed", F.concat(F.left("_text", n - third), F.left(F.coalesce("_next", F.lit("")), third)))
    key = [*RANGE, "_row"]
    # words of both texts, and as a third list the facts of the document, which so come out of the same aggregation
    sha = F.sha2("_changed", 256)
    facts = [*[F.substring(sha, 1 + 16 * k, 16) for k in range(4)], F.hex(n.cast("long")), F.hex("_at"), F.hex(F.col("_guest").cast("long"))]
    lists = F.array(F.split("_text", SPACE), F.split("_changed", SPACE), F.array(*facts))
    words = d.select(*key, F.posexplode(lists).alias("_side", "_words"))
    words = words.select(*key, "_side", F.posexplode("_words").alias("_p", "_w")).where("_w != ''")
    fact = F.col("_side") == 2
    words = words.select(
        *key,
        F.when(fact, F.conv("_w", 16, -10).cast("long")).otherwise(F.xxhash64("_w", F.lit(1))).alias("_word"),
        F.when(fact, 0).otherwise(F.xxhash64("_w", F.lit(2))).alias("_word2"),  # two hashes name a word, 128 bits
        F.when(fact, F.col("_p")).otherwise(-1).alias("_fact"),
        "_side",
    )
    sides = [F.sum(F.when(F.col("_side") == k, 1).otherwise(0)).alias(f"_n{k}") for k in (0, 1)]
    counts = words.groupBy(*key, "_fact", "_word", "_word2").agg(*sides)
    logs = counts.select(*key, "_fact", "_word", F.expr("if(_n0 > 0, ln(_n0), null)").alias("_own"), F.expr("if(_n1 > 0, ln(_n1), null)").alias("_edited"))
    mins = [F.max(F.when(F.col("_fact") == k, F.col("_word"))).alias(f"f{k}") for k in range(len(facts))]
    for k in range(samples):
        own, edited = _sample(k)
        mins += [F.min(F.expr(own)).alias(f"o{k}"), F.min(F.expr(edited)).alias(f"e{k}")]
    prints = logs.groupBy(*key).agg(*mins)
    own, edited = F.array(*[f"o{k}" for k in range(samples)]), F.array(*[f"e{k}" for k in range(samples)])
    out = prints.select(
        *key,
        (F.col("f6") == 1).alias("_guest"),
        F.when(~F.col("_none"), F.bitwise_not("f5")).alias("doc_id"),
        F.col("f4").alias("n_chars"),
        F.lower(F.concat(*[F.lpad(F.hex(f"f{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"),
        own.alias("_own"),
        edited.alias("_edited"),
    )
    out = out.withColumn("_after", F.lead("_own").over(Window.partitionBy(*RANGE).orderBy("_row")))

    def text(c):
        return F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(x), 32))), 8, "0")), "")

    def near(a, b):
        same = [F.when(F.col(a)[k].eqNullSafe(F.col(b)[k]), 1.0).otherwise(0.0) for k in range(samples)]
        return sum(same[1:], same[0]) / samples

    return out.where(~F.col("_guest")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("_own").alias("fingerprint"),
        text("_edited").alias("edited_fingerprint"),
        near("_own", "_edited").alias("near_edited"),
        near("_own", "_after").alias("near_next"),
    )
