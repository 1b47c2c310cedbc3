"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles. A run samples a shared token: the
shingle of least hash under the run's hash function, which two sets share with
the probability of their similarity. Sets of one token form a bucket; a bucket
above ``SMALL`` is split again, on two further sampled tokens of its own, and
so on. Small buckets are compared by brute force. A token that ``ALIKE`` of a
bucket or more share does not split it: these sets are alike and, as what is
large after ``DEPTH`` splits, are dense. Overlapping dense buckets are one group,
compared in cells of ``BLOCK`` by ``BLOCK`` sets, so no group is one task's.
The runs, ``log(1 - recall) / log(1 - threshold)`` of them, bring the chance
to miss a pair at the threshold below ``1 - recall``.

Equal sets are one class, searched once and counted with its copies. A pair
found in several buckets counts in one: the dense group if shared, else the
least common bucket. Comparison is exact, on whole sets of 64-bit shingles.

Defined cases: a text of one to four words is one shingle; null and wordless
texts have none and are classes of their own, without links. Rows equal in id
and text are one row. Rows without id have a null doc_id. Extra columns stay unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import identified, plain_id
from faultline.llm.components import components
from faultline.llm.rolling import Words, mix, text_slices
from faultline.session import cut

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999
COORDINATES = 32
SMALL = 64
DEPTH = 8
ALIKE = 0.6
BLOCK = 1024
COLUMNS = 4096


def _sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash), in order of the text."""
    w = Words(offsets, data)
    at = np.flatnonzero((w.place + SHINGLE <= w.count[w.doc]) | ((w.count[w.doc] < SHINGLE) & (w.place == 0)))
    end = np.minimum(at + SHINGLE, w.first[w.doc[at] + 1])
    h, doc = w.prefix(0).window(at, end), w.doc[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


SIGNATURE = "_id long, _tie long, n long, s1 long, s2 long, signature array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = mix(np.arange(1, COORDINATES + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for batch in batches:
        ids, ties = batch.column("_id").to_numpy(), batch.column("_tie").to_numpy()
        for row, offsets, data in text_slices(batch.column("_text")):
            doc, h = _sets(offsets, data)
            if not len(doc):
                continue
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            count = np.diff(np.concatenate([begin, [len(doc)]]))
            sums = [np.add.reduceat(mix(h ^ s), begin).view(np.int64) for s in seeds[:2]]
            mins = np.stack([np.minimum.reduceat(mix(h ^ s), begin) for s in seeds[2:]], axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(begin) + 1, dtype=np.int32) * COORDINATES, pa.array(mins.ravel()))
            who = doc[begin] + row
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (ids[who], ties[who], count, *sums)), lists], names=["_id", "_tie", "n", "s1", "s2", "signature"]
            )


def _grouped(members: DataFrame) -> DataFrame:
    """Buckets (v, node) of two or more, with their size."""
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, "node")


def _buckets(reps: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """(v, node) of the small buckets, and (v, node) of the large ones that splitting does not shrink."""
    start = reps.select("v", F.posexplode(F.slice("signature", 1, runs)).alias("run", "token"))
    level = cut(_grouped(start.select("v", F.xxhash64("run", "token").alias("node"))))
    small, depth = level.where(f"size <= {SMALL}").select("v", "node"), 0
    large = level.where(f"size > {SMALL}")
    dense = large.select("v", "node").limit(0)
    signatures = reps.select("v", "signature")
    while not large.isEmpty():
        depth += 1
        # two coordinates, chosen by the bucket
        first = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(COORDINATES)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(-depth)), F.lit(COORDINATES - 1)).cast("int"), F.lit(COORDINATES))
        rows = large.join(signatures, "v").select("v", "node", F.col("size").alias("of"), "signature", F.explode(F.array(first, second)).alias("c"))
        rows = rows.select("v", F.xxhash64("node", "c", F.get("signature", F.col("c"))).alias("node"), "of")
        level = cut(_grouped(rows))
        small = small.unionByName(level.where(f"size <= {SMALL}").select("v", "node"))
        stays = f"size >= {ALIKE} * of or {depth >= DEPTH}"
        dense = dense.unionByName(level.where(f"size > {SMALL} and ({stays})").select("v", "node"))
        large = level.where(f"size > {SMALL} and not ({stays})").drop("of")
    large = dense
    # buckets with the same members are compared once
    print_of = small.groupBy("node").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y")
    )
    kept = print_of.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node")
    return cut(small.join(kept, "node", "left_semi").distinct()), large


def _dense_groups(large: DataFrame) -> DataFrame:
    """(v, dense): large buckets that share sets form one group, named by its least set."""
    first = large.groupBy("node").agg(F.min("v").alias("b"))
    found = components(large.join(first, "node").select(F.col("v").alias("a"), "b"))
    return found.select(F.col("node").alias("v"), F.xxhash64("label").alias("dense"))


CELL = "_id long, _tie long, copies long, block int, node long, dense long, i int, j int, nodes array<long>, _text string"
FOUND = "_id long, _tie long, links long, low_id long, low_tie long"


def _compare(rows: list[tuple], same_block: bool, dense: bool) -> pa.RecordBatch | None:
    """Links of one cell; rows are (id, tie, copies, block, node, dense, nodes, text)."""
    texts = [r[7].encode("utf-8", "surrogatepass") for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, h = _sets(offsets, np.frombuffer(b"".join(texts), dtype=np.uint8))
    size = np.bincount(doc, minlength=len(rows))
    _, token, often = np.unique(h, return_inverse=True, return_counts=True)
    shared = often[token] > 1
    doc, token = doc[shared], np.unique(token[shared], return_inverse=True)[1]
    if not len(token):
        return None
    block = np.array([r[3] for r in rows])
    left = np.arange(len(rows)) if same_block else np.flatnonzero(block == block.min())
    right = left if same_block else np.flatnonzero(block != block.min())
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    by = np.argsort(token, kind="stable")
    doc, token = doc[by], token[by]
    for low in range(0, int(token[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(token, [low, low + COLUMNS])
        m = np.zeros((len(rows), min(COLUMNS, int(token[-1]) + 1 - low)), dtype=np.float32)
        m[doc[a:b], token[a:b] - low] = 1
        common += m[left] @ m[right].T
    num, den = THRESHOLD.numerator, THRESHOLD.denominator
    linked = common.astype(np.int64) * (num + den) >= num * (size[left][:, None] + size[right][None, :])
    if same_block:
        linked &= ~np.eye(len(left), dtype=bool)
    if not dense and linked.any():
        node = rows[0][4]
        nodes = [set(r[6]) for r in rows]
        for x, y in zip(*np.nonzero(linked)):
            p, q = rows[left[x]], rows[right[y]]
            if (p[5] is not None and p[5] == q[5]) or min(nodes[left[x]] & nodes[right[y]]) != node:
                linked[x, y] = False
    if not linked.any():
        return None
    copies = np.array([r[2] for r in rows])
    links = np.zeros(len(rows), dtype=np.int64)
    links[left] += (linked * copies[right][None, :]).sum(axis=1)
    if not same_block:
        links[right] += (linked * copies[left][:, None]).sum(axis=0)
    label = np.arange(len(rows))  # rows are in order of id
    while True:
        was = label.copy()
        label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], len(rows)).min(axis=1))
        label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], len(rows)).min(axis=0))
        label = label[label]
        if (label == was).all():
            break
    hit = np.flatnonzero(links > 0)
    ids, ties = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    columns = [ids[hit], ties[hit], links[hit], ids[label[hit]], ties[label[hit]]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and id; a cell has at most two blocks of rows."""
    key, held = None, []
    names = [x.split()[0] for x in CELL.split(", ")]
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in names]):
            r = dict(zip(names, row))
            k = (r["node"], r["i"], r["j"])
            if k != key:
                if len(held) > 1 and (out := _compare(held, key[1] == key[2], held[0][8])) is not None:
                    yield out
                key, held = k, []
            held.append((r["_id"], r["_tie"], r["copies"], r["block"], r["node"], r["dense"], r["nodes"], r["_text"], r["dense"] == r["node"]))
    if len(held) > 1 and (out := _compare(held, key[1] == key[2], held[0][8])) is not None:
        yield out


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", recall: float = RECALL) -> DataFrame:
    """Per document: _id, _tie, class_id (least id of its class), class_tie, n_links (documents at the threshold or above)."""
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - float(THRESHOLD))))
    d = identified(docs, id_col, text_col)
    sets = cut(d.mapInArrow(_signatures, SIGNATURE))
    v = F.struct("_id", "_tie")
    reps = cut(sets.groupBy("s1", "s2").agg(F.min(v).alias("v"), F.count("*").alias("copies"), F.any_value("signature").alias("signature")))
    small, large = _buckets(reps, runs)
    dense = cut(_dense_groups(large))
    sized = dense.groupBy("dense").agg(F.count("*").alias("_size"))
    dense = dense.join(sized, "dense").select("v", "dense", F.ceil(F.col("_size") / BLOCK).cast("int").alias("blocks"))
    dense = dense.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    per = small.groupBy("v").agg(F.collect_list("node").alias("nodes"))
    per = per.join(dense, "v", "full").join(reps.select("v", "copies"), "v")
    per = per.select(F.col("v._id").alias("_vid"), F.col("v._tie").alias("_vtie"), "copies", "nodes", "dense", "blocks", "block")
    rows = d.join(per, (F.col("_id") == F.col("_vid")) & (F.col("_tie") == F.col("_vtie"))).drop("_vid", "_vtie")
    zero, none = F.lit(0), F.array().cast("array<long>")
    leaf = F.transform(F.coalesce("nodes", none), lambda n: F.struct(n.alias("node"), zero.alias("block"), zero.alias("i"), zero.alias("j")))
    other = F.sequence(zero, F.coalesce("blocks", F.lit(1)) - 1)
    cell = F.transform(other, lambda k: F.struct(F.col("dense").alias("node"), F.col("block").alias("block"), F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    cells = F.concat(leaf, F.when(F.col("dense").isNotNull(), cell).otherwise(F.slice(cell, 1, 0)))
    rows = rows.select("_id", "_tie", "copies", "dense", F.coalesce("nodes", none).alias("nodes"), "_text", F.explode(cells).alias("c"))
    rows = rows.select("_id", "_tie", "copies", "c.block", "c.node", "dense", "c.i", "c.j", "nodes", "_text")
    rows = rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "_id", "_tie")
    found = cut(rows.mapInArrow(_cells, FOUND))
    links = found.groupBy(v.alias("v")).agg(F.sum("links").alias("links"))
    label = components(found.select(v.alias("a"), F.struct(F.col("low_id").alias("_id"), F.col("low_tie").alias("_tie")).alias("b")))
    named = reps.select("s1", "s2", "v", "copies").join(links, "v", "left").join(label.withColumnRenamed("node", "v"), "v", "left")
    named = named.select("s1", "s2", F.coalesce("label", "v").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = sets.select("_id", "_tie", "s1", "s2").join(named, ["s1", "s2"]).select("_id", "_tie", F.col("label._id").alias("class_id"), F.col("label._tie").alias("class_tie"), "n_links")
    rest = d.select("_id", "_tie").join(sets.select("_id", "_tie"), ["_id", "_tie"], "left_anti")
    return known.unionByName(rest.select("_id", "_tie", F.col("_id").alias("class_id"), F.col("_tie").alias("class_tie"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that are the least of their class, with their own columns; rows equal in id and text are one."""
    from faultline.llm.common import content_key, private

    p = private(docs)
    classes = near_duplicates(docs, id_col, text_col)
    kept = classes.where("_id = class_id and _tie = class_tie").select(F.col("_id").alias(f"{p}id"), F.col("_tie").alias(f"{p}tie"))
    d = docs.withColumn(f"{p}key", F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)))
    d = d.withColumn(f"{p}content", content_key(f"{p}key", text_col)).dropDuplicates([f"{p}key", f"{p}content"])
    same = (F.col(f"{p}key") == F.col(f"{p}id")) & ((F.col(f"{p}tie") == 0) | (F.col(f"{p}tie") == F.col(f"{p}content")))
    return d.join(kept, same).select(*docs.columns)


def report(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    return near_duplicates(docs, id_col, text_col).select(plain_id().alias("doc_id"), plain_id("class_id").alias("class_id"), "n_links")
