"""Nearest neighbours by largest inner product, over balanced posting lists.

A bounded sample is halved again and again along the line between two means,
at the median, into equal cells; their means are the centroids of the lists.
Every vector goes to its nearest lists, to several where their distances are
within ``SPREAD`` of the least, as on boundaries. Centroids are linked to their
neighbours and some far ones, and a beam search over that graph finds the lists
near a vector or query. A query takes those within ``PRUNE`` times the least
distance. Lists next to each other in the halving form a region of ``REGION``
lists, searched whole for every query that takes one of them; a region is cut
in cells of ``VECTORS`` vectors by ``BLOCK`` queries, so that none is one
task's, and a cell returns the best of all its lists as one. The region of the
nearest list is searched first; its ``k + 1``th best is a floor, and from the
other regions only what reaches the floor comes back, so what a query returns
hardly grows with its regions.

Inner product becomes distance by one more coordinate, which brings all
vectors to the greatest norm; a query has 0 there.

Equal vectors are one entry with its 21 smallest ids, found by salted ranking:
no query can use more. The centroids, at most ``MAX_LISTS``, are the only data
sent to all tasks.

Defined cases: vectors that are null, zero, hold null or non-finite parts, or
have not the commonest length take no part. Rows equal in id and vector are
one. With fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut

MAX_LISTS = 4096
LIST_ROWS = 128
SAMPLE_PER_LIST = 16
LINKS, FAR_LINKS = 16, 4
BEAM = 256
COPIES, SPREAD = 2, 1.05
PRUNE = 1.14
REGION = 32
VECTORS, BLOCK = 8192, 1024
SALTS = 64


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, k1, k2): vectors that take part, as doubles, with 128 bits that name the vector."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    d = d.where(fine)
    size = d.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    d = d.where(F.size("vec") == (size[0]["n"] if size else 0))
    return d.select("vec_id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64("vec", F.lit(1)).alias("k2"))


def entries(d: DataFrame, k: int) -> DataFrame:
    """(k1, k2, vec, ids): distinct vectors with their k + 1 smallest ids."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    d = d.select("vec_id", "k1", "k2", "vec", salt.alias("salt")).dropDuplicates(["vec_id", "k1", "k2"])
    few = d.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return few.groupBy("k1", "k2").agg(F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Lists:
    """Centroids of the lists and the graph over them."""

    def __init__(self, sample: np.ndarray, lists: int, norm: float):
        self.norm = norm
        rng = np.random.default_rng(0)
        cells, todo = [], [(self.lifted(sample), lists)]
        while todo:
            x, want = todo.pop()
            if want <= 1 or len(x) < 2:
                cells.append(x.mean(axis=0))
                continue
            a, b = x[rng.choice(len(x), 2, replace=False)]
            for _ in range(8):
                near = ((x - a) ** 2).sum(1) < ((x - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = x[near].mean(0), x[~near].mean(0)
            order = np.argsort(x @ (a - b), kind="stable")
            half = len(x) // 2
            # the last is halved first, so neighbours in space have numbers in a row
            todo += [(x[order[:half]], want // 2), (x[order[half:]], want - want // 2)]
        self.centroids = np.array(cells)
        distance = self._square(self.centroids, self.centroids)
        n = len(cells)
        near = np.argsort(distance, axis=1, kind="stable")[:, 1 : LINKS + 1]
        far = rng.integers(0, n, (n, FAR_LINKS))
        self.links = np.concatenate([near, far], axis=1) if n > 1 else np.zeros((1, 1), dtype=np.int64)
        self.entry = int(np.argmin(((self.centroids - self.centroids.mean(0)) ** 2).sum(1)))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    @staticmethod
    def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0.0)

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists near each row of x and their distances, ascending, by a beam search for all rows at once."""
        n, rows = len(self.centroids), np.arange(len(x))
        beam = min(beam, n)
        norms = (self.centroids**2).sum(1)
        own = (x**2).sum(1)
        seen = np.zeros((len(x), n), dtype=bool)
        seen[:, self.entry] = True
        best = np.full((len(x), beam), -1)
        value = np.full((len(x), beam), np.inf)
        open_ = np.zeros((len(x), beam), dtype=bool)
        best[:, 0], open_[:, 0] = self.entry, True
        value[:, 0] = own + norms[self.entry] - 2 * x @ self.centroids[self.entry]
        while open_.any():
            step = np.where(open_, value, np.inf).argmin(1)
            live = rows[open_.any(1)]
            at = best[live, step[live]]
            open_[live, step[live]] = False
            to = self.links[at]
            d = own[live, None] + norms[to] - 2 * np.einsum("rd,rkd->rk", x[live], self.centroids[to])
            d[seen[live[:, None], to]] = np.inf
            # a centroid that is linked twice counts once
            for k in range(1, to.shape[1]):
                d[(to[:, :k] == to[:, k : k + 1]).any(1), k] = np.inf
            seen[live[:, None], to] = True
            ids = np.concatenate([best[live], to], axis=1)
            all_ = np.concatenate([value[live], d], axis=1)
            more = np.concatenate([open_[live], np.isfinite(d)], axis=1)
            keep = np.argsort(all_, axis=1, kind="stable")[:, :beam]
            best[live] = np.take_along_axis(ids, keep, 1)
            value[live] = np.take_along_axis(all_, keep, 1)
            open_[live] = np.take_along_axis(more, keep, 1) & np.isfinite(value[live])
        return best, np.sqrt(np.maximum(value, 0.0))


def fit(e: DataFrame) -> Lists:
    """Centroids from the entries of least hash, at most ``MAX_LISTS * SAMPLE_PER_LIST`` of them."""
    n = e.count()
    lists = max(1, min(MAX_LISTS, n // LIST_ROWS))
    rows = e.orderBy("k1", "k2").limit(lists * SAMPLE_PER_LIST).select("vec").collect()
    squared = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    norm = e.agg(F.max(F.sqrt(squared))).first()[0] or 1.0
    return Lists(np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), -1), lists, float(norm))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assign(model, ratio: float, most: int, beam: int, queries: bool):
    """Rows of (.., vec) with an array of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = model.value
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                x = _matrix(part.column("vec"))
                x = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if queries else lists.lifted(x)
                found, distance = lists.nearest(x, beam)
                good = (distance <= ratio * distance[:, :1]) & (found >= 0)
                good &= np.cumsum(good, axis=1) <= most
                offsets = np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32)
                chosen = pa.ListArray.from_arrays(offsets, pa.array(found[good].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, chosen], names=[*part.schema.names, "lists"])

    return run


def _search(k: int):
    def run(posts: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("q1", "q2", "k1", "k2", "score", "ids")}
        if len(posts) and len(queries):
            v, q = np.stack(posts["vec"].to_numpy()), np.stack(queries["vec"].to_numpy())
            least = np.array([x[0] for x in posts["ids"]])
            keys, qkeys = posts[["k1", "k2"]].to_numpy(), queries[["k1", "k2"]].to_numpy()
            floor = queries["floor"].to_numpy()
            rough = q @ v.T
            for r in range(len(q)):
                edge = floor[r]
                if len(v) > k + 1 and edge == -np.inf:
                    edge = np.partition(rough[r], len(v) - k - 1)[len(v) - k - 1]
                top = np.flatnonzero(rough[r] >= edge - 1e-9 * max(1.0, abs(edge))) if edge > -np.inf else np.arange(len(v))  # ties and rounding
                if not len(top):
                    continue
                score = (v[top] * q[r]).sum(axis=1)
                best = np.lexsort((least[top], -score))[: k + 1]
                best = best[score[best] >= floor[r]]
                top, score = top[best], score[best]
                out["q1"] += [qkeys[r, 0]] * len(top)
                out["q2"] += [qkeys[r, 1]] * len(top)
                out["k1"] += list(keys[top, 0])
                out["k2"] += list(keys[top, 1])
                out["score"] += list(score)
                out["ids"] += list(posts["ids"].to_numpy()[top])
        return pd.DataFrame(out | {"ids": pd.Series(out["ids"], dtype=object)})  # a type even where nothing is found

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col="vec_id", vec_col="embedding", prune: float = PRUNE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every query, itself excluded."""
    spark = vectors.sparkSession
    d = cut(usable(vectors, id_col, vec_col))
    e = cut(entries(d, k))
    empty = "query_id long, rank int, vec_id long, score double"
    if e.isEmpty():
        return spark.createDataFrame([], empty)
    model = spark.sparkContext.broadcast(fit(e))  # at most MAX_LISTS centroids
    schema = "k1 long, k2 long, vec array<double>, ids array<long>, lists array<int>"
    regions = F.array_distinct(F.transform("lists", lambda x: F.floor(x / REGION).cast("int")))  # nearest first
    posts = e.mapInArrow(_assign(model, SPREAD, COPIES, 4 * COPIES, queries=False), schema)
    posts = cut(posts.select("k1", "k2", "vec", "ids", F.explode(regions).alias("region")))
    q = d.where(is_query).select("vec_id", "k1", "k2", "vec")
    distinct = q.groupBy("k1", "k2").agg(F.any_value("vec").alias("vec"))
    probes = distinct.mapInArrow(_assign(model, prune, MAX_LISTS, BEAM, queries=True), "k1 long, k2 long, vec array<double>, lists array<int>")
    probes = cut(probes.select("k1", "k2", "vec", regions.alias("regions")))

    def blocks(t: DataFrame, rows: int, name: str) -> DataFrame:
        return t.groupBy("region").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    def search(probes: DataFrame) -> DataFrame:
        sizes = blocks(posts, VECTORS, "nv").join(blocks(probes, BLOCK, "nq"), "region")

        def cells(t: DataFrame, own: str, other: str, ov: str, qv: str) -> DataFrame:
            t = t.join(sizes, "region").withColumn(ov, F.pmod("k2", F.col(own)).cast("int"))
            return t.withColumn(qv, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("nv", "nq")

        left = cells(posts, "nv", "nq", "bv", "bq").groupBy("region", "bv", "bq")
        right = cells(probes, "nq", "nv", "bq", "bv").groupBy("region", "bv", "bq")
        return left.cogroup(right).applyInPandas(_search(k), "q1 long, q2 long, k1 long, k2 long, score double, ids array<long>")

    none = F.lit(float("-inf"))
    home = cut(search(probes.select("k1", "k2", "vec", F.get("regions", F.lit(0)).alias("region"), none.alias("floor"))))
    # entries of one region are distinct, so k + 1 entries reach the floor
    falling = Window.partitionBy("q1", "q2").orderBy(F.desc("score"))
    floors = home.select("q1", "q2", F.col("score").alias("f"), F.row_number().over(falling).alias("r")).where(F.col("r") == k + 1)
    known = (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2"))
    others = probes.join(floors, known, "left").select(
        "k1", "k2", "vec", F.explode(F.slice("regions", 2, MAX_LISTS)).alias("region"), F.coalesce("f", none).alias("floor")
    )
    found = home.unionByName(search(cut(others)))
    found = found.groupBy("q1", "q2", "k1", "k2").agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"))
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    # every query of a vector has the same list, but for itself
    mine = q.select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).distinct()
    rows = mine.join(found, ["q1", "q2"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
