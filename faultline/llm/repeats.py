"""Finding repeated windows over a corpus: anchors, their contexts, and what stays open.

An anchor is a short window that all equal long windows share; its context
holds the long windows it stands for. A row has the anchor's hash, the hash of
the context, and the place. Contexts equal to an earlier one settle all their
windows at once. Only where an anchor has different contexts, single windows
have to be compared; there the first place of each context stands for the rest.

Rows of one anchor are brought together by a sort on disk and read in order,
with the neighbour's and the group's extreme contexts as the only state. Equal
contexts within a slice of texts are combined before the shuffle, so a passage
of many documents sends one row per slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = "anchor long, context long, _id long, _tie long, place int, extent int, settled boolean"


def anchor_batch(anchor, context, ids, ties, place, extent, first_only: bool) -> pa.RecordBatch:
    """Rows of a slice; repeats within it come out settled, all but one, which goes on.

    With ``first_only`` the one is the first by id and place and is not settled by them.
    """
    settled = np.zeros(len(anchor), dtype=bool)
    order = np.lexsort((context, anchor))
    a, c = anchor[order], context[order]
    same = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
    if same.any():
        group = np.concatenate([[0], np.cumsum(~same)])
        many = np.zeros(len(order), dtype=bool)
        many[1:] |= same
        many[:-1] |= same
        rows, of = order[many], group[many]
        rank = np.lexsort((place[rows], ties[rows], ids[rows], of))
        rows, of = rows[rank], of[rank]
        settled[rows[1:][of[1:] == of[:-1]]] = True
    twice = np.zeros(len(anchor), dtype=bool)
    if same.any() and not first_only:
        twice[rows[:-1][of[1:] == of[:-1]]] = True  # the one that goes on is settled too, by a second row
        twice &= ~settled
    keep = np.concatenate([np.arange(len(anchor)), np.flatnonzero(twice)])
    settled = np.concatenate([settled, np.ones(int(twice.sum()), dtype=bool)])
    columns = [anchor.view(np.int64)[keep], context.view(np.int64)[keep], ids[keep], ties[keep], place[keep].astype(np.int32), extent[keep].astype(np.int32), settled]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in ROWS.split(", ")])


def settle(rows: DataFrame, first_only: bool, open_windows: bool = True, heavy: tuple[Column, int] | None = None) -> DataFrame:
    """(_id, _tie, place, extent, open): settled places, and with ``open_windows`` those still to compare.

    ``first_only``: a context is settled by an earlier equal one; else by any other.
    ``heavy``: the size of a context, and what the open ones of an anchor may sum to; beyond
    that they come out with the further column ``hot`` true.
    """
    done = rows.where("settled").select("_id", "_tie", "place", "extent", F.lit(False).alias("open"))
    w = Window.partitionBy("anchor").orderBy("context", "_id", "_tie", "place")
    r = rows.where("not settled").select(
        "_id", "_tie", "place", "extent",
        (F.lag("context").over(w).eqNullSafe(F.col("context"))).alias("again"),
        (F.lead("context").over(w).eqNullSafe(F.col("context"))).alias("more"),
        "anchor", "context",
    )
    if open_windows:
        every = Window.partitionBy("anchor")
        r = r.withColumn("varies", F.min("context").over(every) != F.max("context").over(every))
    else:
        r = r.withColumn("varies", F.lit(False))
    known = F.col("again") if first_only else F.col("again") | F.col("more")
    kinds = F.filter(F.array(F.when(known, False), F.when(~F.col("again") & F.col("varies"), True)), lambda x: x.isNotNull())
    extra = []
    if heavy:
        size, most = heavy
        r = r.withColumn("hot", F.col("varies") & (F.sum(F.when(~F.col("again"), size)).over(Window.partitionBy("anchor")) > most))
        done, extra = done.withColumn("hot", F.lit(False)), ["hot"]
    found = r.where(known | (~F.col("again") & F.col("varies")))
    return done.unionByName(found.select("_id", "_tie", "place", "extent", *extra, F.explode(kinds).alias("open")))


def marks(found: DataFrame) -> DataFrame:
    """Per document, the settled places with extents, and the open ones."""
    spot = F.struct("place", "extent")
    return found.groupBy(F.col("_id").alias("_mid"), F.col("_tie").alias("_mtie")).agg(
        F.collect_list(F.when(~F.col("open"), spot)).alias("settled"), F.collect_list(F.when(F.col("open"), spot)).alias("open")
    )


def with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    m = marks(found)
    same = (F.col("_id") == F.col("_mid")) & (F.col("_tie") == F.col("_mtie"))
    return docs.join(m, same, "left").drop("_mid", "_mtie")


def spots(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and extents of one row of ``settled`` or ``open``."""
    if not column.is_valid()[row].as_py():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
    part = column.values.slice(a, b - a)
    return part.field("place").to_numpy().astype(np.int64), part.field("extent").to_numpy().astype(np.int64)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the spans."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:-1] > 0
