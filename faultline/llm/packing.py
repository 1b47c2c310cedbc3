"""Best-fit packing of documents into sequences under conflicts.

Documents of more than ``capacity`` words are cut into full pieces, each a bin
of its own, and a rest. Rests are packed by best fit, longest first: open bins
are kept in order of room; the search starts at the least room that suffices
and goes on to the next bin until one is compatible, or a bin is opened. A bin
carries two bitmaps: its duplicate clusters, of which a bin takes one document
each, and its sources, one plane for each time a source may stand in a bin.

The work is dealt by hash into shards of about ``SHARD_ROWS`` documents, whose
number grows with the table, so no source or cluster is packed in one task.
Only ids and numbers are shuffled, no texts.

Defined cases: a null text has no words and is placed in no bin (bin null).
Documents without a cluster conflict with none; a null source is a source.
Ties are broken by id, then content key. Rows equal in id and text are numbered
copies of one cluster and go to different bins. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import content_key, plain_id, text_or_empty, word_count
from faultline.session import cut

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ROWS = 4096


class Bins:
    """Open bins by room, each with its bitmaps."""

    def __init__(self, per_source: int):
        self.per_source = per_source
        self.order: list[tuple[int, int]] = []  # (room, bin), ascending
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []

    def place(self, size: int, source: int, cluster: int, capacity: int) -> int:
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not (self.clusters[number] & cluster) and not (self.sources[number][-1] & source):
                self.order.pop(at)
                break
            at += 1
        else:
            room, number = capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[number] |= cluster
        carry = source
        planes = self.sources[number]
        for k in range(self.per_source):
            planes[k], carry = planes[k] | carry, planes[k] & carry
        if room > size:
            insort(self.order, (room - size, number))
        return number


def _pack_shard(capacity: int, per_source: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rest", "doc_id", "key", "copy"], ascending=[False, True, True, True])
        sources = {s: 1 << k for k, s in enumerate(dict.fromkeys(rows["source"].where(rows["source"].notna(), None)))}
        count = rows["cluster"].value_counts()
        # one bit for each cluster that has several members here; others conflict with none
        clusters = {c: 1 << k for k, c in enumerate(sorted(count[count > 1].index))}
        bins = Bins(per_source)
        used: dict[int, int] = {}
        number, offset = [], []
        for size, source, cluster in zip(rows["rest"], rows["source"].where(rows["source"].notna(), None), rows["cluster"]):
            b = bins.place(int(size), sources[source], clusters.get(cluster, 0), capacity)
            number.append(b)
            offset.append(used.get(b, 0))
            used[b] = used.get(b, 0) + int(size)
        return pd.DataFrame(
            {"shard": rows["shard"], "doc_id": rows["doc_id"], "copy": rows["copy"], "size": rows["size"], "rest": rows["rest"],
             "source": rows["source"], "number": number, "at": offset, "bin_words": [used[b] for b in number]}
        )

    return run


def pack(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", cluster: Column | None = None,
         capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """doc_id, copy, size, source, piece, words, bin, offset (words before it in the bin), bin_words.

    ``cluster``: what documents may not share a bin; the words of the text by default.
    """
    if cluster is None:
        cluster = F.xxhash64(F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " "))
    d = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc_id"),
        content_key(id_col, text_col).alias("key"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        cluster.cast("long").alias("cluster"),
    )
    d = d.groupBy(*d.columns).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    d = cut(d.withColumn("rest", F.col("size") % capacity))
    shards = max(1, -(-d.count() // SHARD_ROWS))
    # clusters are dealt out by their members' keys, and repeated rows by their numbers, so that copies spread over the shards
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "copy"), F.lit(shards)))
    out = "shard long, doc_id long, copy long, size long, rest long, source string, number long, at long, bin_words long"
    rests = d.where("rest > 0").groupBy("shard").applyInPandas(_pack_shard(capacity, per_source), out)
    zero, cap = F.lit(0).cast("long"), F.lit(capacity).cast("long")
    pieces = F.floor(F.col("size") / capacity).cast("long")
    head = [plain_id("doc_id").alias("doc_id"), "copy", "size", "source"]
    name = F.concat_ws("-", F.lit("s"), "shard", "number")
    last = rests.select(*head, pieces.alias("piece"), F.col("rest").alias("words"), name.alias("bin"), F.col("at").alias("offset"), "bin_words")
    full = d.where(F.col("size") >= capacity).withColumn("piece", F.explode(F.sequence(zero, pieces - 1)))
    name = F.concat_ws("-", F.lit("d"), "doc_id", "key", "copy", "piece")
    full = full.select(*head, "piece", cap.alias("words"), name.alias("bin"), zero.alias("offset"), cap.alias("bin_words"))
    none = [F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("bin_words")]
    empty = d.where("size = 0").select(*head, zero.alias("piece"), zero.alias("words"), *none)
    return last.unionByName(full).unionByName(empty)
