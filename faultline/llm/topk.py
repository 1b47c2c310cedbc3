"""Exact search of the largest inner products, by distances from pivots.

Components become ``floor(scale * x)``; a score is an integer inner product.
One more coordinate brings all vectors to the greatest norm (a query has 0
there), so the largest product is the least distance. Each vector is keyed by
its nearest pivot and the distance from it; the keys of a pivot are cut in
annuli at quantiles of a bounded sample. By the triangle inequality no vector
of an annulus ``[low, high]`` is nearer to a query at distance ``d`` from the
pivot than ``low - d`` or ``d - high``, which bounds its score.

A query takes the annuli by rising bound, ``STEPS`` at a time. After each step
the ``k + 1``th best row found is its floor, and it stops before the first
annulus whose bound is below the floor; that every annulus is taken is possible
where pivots say little. An annulus is searched in cells of ``CELL`` vectors by
``BLOCK`` queries, so no annulus is one task's, however many vectors share it.

Only pivots and limits of annuli, at most ``PIVOTS`` and ``ANNULI``, are sent to all
tasks; the sample has at most ``SAMPLE_BYTES``. The index may be fitted badly,
results stay exact: limits of annuli are read from all their vectors, and bounds
have room for rounding.

Equal vectors are one entry with their ``k + 1`` smallest ids, found by salted
ranking; no query can use more.

Defined cases: vectors that are null, empty, hold null or non-finite components,
whose scaled squares sum to 2^62 or more (products would pass 64 bits), or that
have not the commonest length (of equally common ones the least) take no part,
neither do null ids. Rows equal in id and vector are one. An id with several
vectors asks once for each and gets a list for each; each is a candidate of the
others. Ties go to the smaller id. With fewer candidates than ``k`` all are
returned. Extra columns do not pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut

PIVOTS, ANNULI, ANNULUS_ROWS = 128, 4096, 1024
SAMPLE_BYTES, SAMPLE_ROWS = 32 << 20, 16384
STEPS = (4, 16, 64, 256)  # annuli of a query by round; then all that are left
CELL, BLOCK = 8192, 512
SALTS = 64
EXACT = 2.0**53  # products up to this are exact in doubles
ROOM = 1e-9  # for rounding, as a part of the squares


def usable(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, k1, k2, asked): rows that take part, with scaled components and 128 bits that name the vector."""
    raw = F.col(vec_col)
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(raw, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    d = vectors.where(F.col(id_col).isNotNull() & (F.size(raw) > 0) & fine)
    d = d.select(F.col(id_col).alias("id"), scaled.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    d = d.where(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < 2.0**62)
    d = d.select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64("vec", F.lit(1)).alias("k2"), "asked")
    d = cut(d)
    size = d.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return d.where(F.size("vec") == (size[0]["n"] if size else 0))


def entries(d: DataFrame, k: int) -> DataFrame:
    """(k1, k2, vec, ids): distinct vectors with their k + 1 smallest ids."""
    d = d.select("k1", "k2", "vec", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = d.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2", "vec", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("k1", "k2", "vec").orderBy("id"))).where(F.col("r") <= k + 1)
    return few.groupBy("k1", "k2", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


class Pivots:
    """Pivots, and for each the inner limits of its annuli."""

    def __init__(self, sample: np.ndarray, square: int, n: int):
        self.square = float(square)
        x = self.lifted(sample)
        want = min(PIVOTS, max(1, int((n / 256) ** 0.5)), len(x))
        chosen = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))][None, :]
        apart = np.full(len(x), np.inf)
        while len(chosen) < want:  # the farthest from those chosen
            apart = np.minimum(apart, ((x - chosen[-1]) ** 2).sum(1))
            chosen = np.concatenate([chosen, x[np.argmax(apart)][None, :]])
        for _ in range(5):
            own = self._distances(x, chosen).argmin(1)
            chosen = np.array([x[own == p].mean(0) if (own == p).any() else chosen[p] for p in range(len(chosen))])
        self.pivots = chosen
        distance = self._distances(x, chosen)
        own = distance.argmin(1)
        annuli = min(ANNULI, max(1, n // ANNULUS_ROWS))
        self.limits = []
        for p in range(len(chosen)):
            r = np.sort(distance[own == p, p])
            parts = int(min(max(1, round(annuli * len(r) / len(x))), max(1, len(r) // 4)))
            self.limits.append(np.unique(np.quantile(r, np.arange(1, parts) / parts)) if parts > 1 else np.zeros(0))
        self.first = np.cumsum([0] + [len(v) + 1 for v in self.limits])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.square - (x**2).sum(1), 0.0))[:, None]], axis=1)

    @staticmethod
    def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """From differences, which keep small distances exact."""
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus and distance from the pivot of each vector."""
        distance = self._distances(self.lifted(x), self.pivots)
        own = distance.argmin(1)
        r = distance[np.arange(len(x)), own]
        annulus = np.array([self.first[p] + np.searchsorted(self.limits[p], v) for p, v in zip(own, r)], dtype=np.int32)
        return annulus, r

    def pivot_of(self, annulus: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, annulus, "right") - 1


def fit(e: DataFrame) -> Pivots | None:
    """Pivots from the entries of least hash; None without entries."""
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x)
    facts = e.agg(F.count("*").alias("n"), F.max(square).alias("square"), F.max(F.size("vec")).alias("dim")).first()
    if not facts["n"]:
        return None
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * facts["dim"])))
    sample = e.orderBy("k1", "k2").limit(rows).select("vec").toArrow()
    return Pivots(_matrix(sample["vec"]), facts["square"], facts["n"])


def _key(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                annulus, r = model.value.keys(_matrix(part.column("vec")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(annulus), pa.array(r)], names=[*part.schema.names, "annulus", "r"])

    return run


def _take(model, limits, begin: int, end: int | None):
    """The annuli ``begin`` to ``end`` of each query by rising bound, as far as the floor lets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, (number, low, high) = model.value, limits.value
        owner = pivots.pivot_of(number)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                q = _matrix(part.column("vec")).astype(np.float64)
                floor = part.column("floor").to_numpy(zero_copy_only=False)
                far = pivots._distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots.pivots)[:, owner]
                bound = np.maximum(0.0, np.maximum(low - far, far - high))
                order = np.lexsort((far, bound))[:, begin:end]
                both = (q**2).sum(1) + pivots.square
                score = (both[:, None] - np.take_along_axis(bound, order, 1) ** 2) / 2 + ROOM * both[:, None] + 1
                good = ~(score < floor[:, None])  # a floor that is not known is NaN
                offsets = pa.array(np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32))
                taken = pa.ListArray.from_arrays(offsets, pa.array(number[order][good]))
                yield pa.RecordBatch.from_arrays([*part.columns, taken], names=[*part.schema.names, "annuli"])

    return run


def _search(k: int):
    """The best k + 1 entries of a cell for each query of a block, by score and least id."""

    def run(cell: pa.Table, block: pa.Table) -> pa.Table:
        long = pa.int64()
        types = pa.schema([("q1", long), ("q2", long), ("e1", long), ("e2", long), ("score", long), ("ids", cell.schema.field("ids").type)])
        if not len(cell) or not len(block):
            return types.empty_table()
        v, q = _matrix(cell["vec"]), _matrix(block["vec"])
        most = (v.astype(np.float64) ** 2).sum(1).max() * (q.astype(np.float64) ** 2).sum(1).max()
        scores = (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if most < EXACT**2 else q @ v.T
        floor = block["floor"].to_numpy()
        edge = np.full(len(q), np.iinfo(np.int64).min)
        known = ~np.isnan(floor)
        edge[known] = block["least"].to_numpy()[known]
        if len(v) > k + 1:
            edge = np.maximum(edge, np.partition(scores, len(v) - k - 1, axis=1)[:, len(v) - k - 1])
        row, at = np.nonzero(scores >= edge[:, None])
        score = scores[row, at]
        ids = cell["ids"].combine_chunks()
        least = ids.flatten().take(pa.array(ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()))
        place = np.empty(len(v), dtype=np.int64)  # order of the least ids
        place[pc.sort_indices(least).to_numpy()] = np.arange(len(v))
        order = np.lexsort((place[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank <= k
        row, at, score = pa.array(row[keep]), pa.array(at[keep]), score[keep]
        names = [t[c].combine_chunks().take(i) for t, i in ((block, row), (cell, at)) for c in ("k1", "k2")]
        return pa.Table.from_arrays([*names, pa.array(score), ids.take(at)], schema=types)

    return run


def _probe(posts: DataFrame, probes: DataFrame, k: int, kind: str) -> DataFrame:
    """Search the annuli of ``probes``, in cells of vectors by blocks of queries."""
    sizes = [t.groupBy("annulus").agg(F.ceil(F.count("*") / rows).cast("int").alias(c)) for t, rows, c in ((posts, CELL, "cells"), (probes, BLOCK, "blocks"))]
    sizes = sizes[0].join(sizes[1], "annulus")

    def spread(t: DataFrame, own: str, other: str, name: str, all_: str) -> DataFrame:
        t = t.join(F.broadcast(sizes), "annulus").withColumn(name, F.pmod("k2", F.col(own)).cast("int"))  # a row an annulus
        return t.withColumn(all_, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("cells", "blocks")

    keys = ("annulus", "cell", "block")
    left = spread(posts, "cells", "blocks", "cell", "block").groupBy(*keys)
    right = spread(probes, "blocks", "cells", "block", "cell").groupBy(*keys)
    return left.cogroup(right).applyInArrow(_search(k), f"q1 long, q2 long, e1 long, e2 long, score long, ids array<{kind}>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score of the k highest integer products of every query; itself excluded."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    d = usable(vectors, is_query, scale, id_col, vec_col)
    e = cut(entries(d, k))
    fitted = fit(e)
    out = f"query_id {kind}, rank int, `{id_col}` {kind}, score long"
    if fitted is None:
        return spark.createDataFrame([], out)
    model = spark.sparkContext.broadcast(fitted)  # at most PIVOTS vectors and ANNULI limits
    index = cut(e.mapInArrow(_key(model), f"k1 long, k2 long, vec array<long>, ids array<{kind}>, annulus int, r double"))
    annuli = index.groupBy("annulus").agg(F.min("r").alias("low"), F.max("r").alias("high")).orderBy("annulus").toArrow()
    limits = spark.sparkContext.broadcast([annuli[c].to_numpy() for c in ("annulus", "low", "high")])
    asked = d.where("asked").select("id", "k1", "k2", "vec").distinct()
    unknown = F.lit(None).cast("long")
    state = cut(asked.groupBy("k1", "k2").agg(F.any_value("vec").alias("vec")).select("k1", "k2", "vec", unknown.alias("least")))
    posts = index.select("annulus", "k1", "k2", "vec", "ids")
    found, begin = None, 0
    for step in (*STEPS, None):
        if begin >= len(annuli):
            break
        end = None if step is None else begin + step
        asks = state.withColumn("floor", F.coalesce(F.col("least").cast("double"), F.lit(float("nan"))))
        taken = asks.mapInArrow(_take(model, limits, begin, end), "k1 long, k2 long, vec array<long>, least long, floor double, annuli array<int>")
        probes = cut(taken.select("k1", "k2", "vec", F.coalesce("least", F.lit(0).cast("long")).alias("least"), "floor", F.explode("annuli").alias("annulus")))
        begin = len(annuli) if step is None else end
        if probes.isEmpty():
            break
        new = _probe(posts, probes, k, kind)
        new = new if found is None else found.unionByName(new)
        best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
        found = cut(new.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
        # at most k + 1 entries of k + 1 ids each: the k + 1th best row
        falling = Window.partitionBy("q1", "q2").orderBy(F.desc("score"))
        floors = found.select("q1", "q2", "score", F.explode("ids")).withColumn("r", F.row_number().over(falling))
        floors = floors.where(F.col("r") == k + 1).select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.col("score").alias("least"))
        state = cut(state.drop("least").join(floors, ["k1", "k2"], "left").select("k1", "k2", "vec", "least"))
    if found is None:
        return spark.createDataFrame([], out)
    # every query of a vector has the same list, but for itself
    mine = asked.select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    rows = mine.join(found, ["q1", "q2"]).withColumn("id", F.explode("ids"))
    rows = rows.where("not (id = query_id and e1 = q1 and e2 = q2)")
    order = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", F.col("id").alias(id_col), "score")
