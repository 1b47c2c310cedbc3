"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, gone through up to
``max_repeat`` times. A copy's virtual finish time is the tokens of its source
up to and with it, divided by the source's target. All copies are ranged by
finish time and the order is cut where the total budget is reached, so each
source has then given its target, but for less than a document.

No source is gathered in one task: running sums are taken within hash ranges
of a source, on top of the sums of the ranges before. The order by finish time
is cut the same way: by the sums of time ranges, then within a single range.

Defined cases: a null source is a source of its own, last in order. Null or
wordless texts have size 0 and are never taken. Rows equal in id, source and
text are one item, taken together. Order within a source is by MD5 of id and
text, so reruns agree. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import content_key, private, word_count
from faultline.session import cut

RANGE_ROWS = 4096
KEY_SPAN = 1 << 60  # content_key is below this


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> with weight and target, which sum to all sizes.

    Sources in code-point order take the weights in turn. A target is
    ``min(max_repeat * size, level * weight)``; sorted by the level at which a
    source is full, the level follows from running sums.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(turn) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    s = s.withColumn("_cap", F.col("source_size") * max_repeat).withColumn("_full", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    s = s.withColumn("_level", level).withColumn("_place", F.row_number().over(order))
    fits = F.when(F.col("_level") <= F.col("_full") * (1 + 1e-12), F.struct("_place", "_level"))
    s = s.withColumn("_level", F.min(fits).over(every)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per item: id, source, key, rows, size, source_size, weight, target, copies."""
    items = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            content_key(id_col, text_col).alias("key"),
            word_count(F.col(text_col)).alias("size"),
        )
        .groupBy("doc_id", "source", "key", "size")
        .agg(F.count("*").alias("rows"))
    )
    spark = docs.sparkSession
    n = items.count()
    ranges = max(1, n // RANGE_ROWS)
    items = items.withColumn("_all", F.col("size") * F.col("rows"))
    targets = source_targets(items.groupBy("source").agg(F.sum("_all").alias("source_size")), weights, max_repeat)
    items = items.withColumn("_range", F.floor(F.col("key") / F.lit(KEY_SPAN / ranges)))
    parts = items.groupBy("source", "_range").agg(F.sum("_all").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    parts = _join_source(parts, targets).withColumnRenamed("source", "_source").withColumnRenamed("_range", "_r")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r"))
    within = Window.partitionBy("source", "_range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    queued = items.withColumn("_cum", F.sum("_all").over(within)).join(parts, same).drop("_source", "_r", "_range")
    queued = cut(queued.withColumn("_cum", F.col("_cum") + F.col("_ahead")).drop("_ahead"))
    budget = items.agg(F.coalesce(F.sum("_all"), F.lit(0))).first()[0]
    times = [F.try_divide(F.col("source_size") * e + F.col("_cum"), F.col("target")) for e in range(max_repeat)]
    copies = queued.where("size > 0 and target > 0").select(
        "doc_id", "source", "key", "_all", F.posexplode(F.array(*times)).alias("epoch", "finish")
    )
    # finish times in [0, inf) fall into equal ranges of t / (1 + t)
    copies = copies.withColumn("_range", F.floor(F.col("finish") / (1 + F.col("finish")) * F.lit(float(ranges))))
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = copies.groupBy("_range").agg(F.sum("_all").alias("_sum")).withColumn("_upto", F.sum("_sum").over(order))
    # the first range whose end passes the budget; one row
    edge = sums.where(F.col("_upto") > budget).agg(F.min(F.struct("_range", "_upto", "_sum")).alias("e")).first()["e"]
    if edge is None:  # the budget takes every copy
        taken = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in times), F.lit(0))
    else:
        place = F.struct("finish", "source", "key", "doc_id", "epoch")
        run = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
        at = copies.where(F.col("_range") == edge["_range"]).withColumn("_upto", F.sum("_all").over(run) + (edge["_upto"] - edge["_sum"]))
        last = at.where(F.col("_upto") <= budget).agg(F.max(place).alias("last"))
        # the place of the last copy within the budget, one row, is broadcast as a literal-sized table
        last = spark.createDataFrame(last.collect(), last.schema).first()["last"]
        if last is None:
            taken = sum((F.when(F.floor(t / (1 + t) * F.lit(float(ranges))) < edge["_range"], 1).otherwise(0) for t in times), F.lit(0))
        else:
            types = {f.name: f.dataType for f in queued.schema}
            bound = F.struct(
                F.lit(last["finish"]).alias("finish"),
                F.lit(last["source"]).cast(types["source"]).alias("source"),
                F.lit(last["key"]).alias("key"),
                F.lit(last["doc_id"]).cast(types["doc_id"]).alias("doc_id"),
                F.lit(last["epoch"]).alias("epoch"),
            )
            own = [F.struct(t.alias("finish"), "source", "key", "doc_id", F.lit(e).alias("epoch")) for e, t in enumerate(times)]
            taken = sum((F.when(t.isNotNull() & (p <= bound), 1).otherwise(0) for t, p in zip(times, own)), F.lit(0))
    copies_taken = F.when(F.col("size") > 0, taken).otherwise(0).cast("int")
    return queued.select("doc_id", "source", "key", "rows", "size", "source_size", "weight", "target", copies_taken.alias("copies"))


def _join_source(left: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumnRenamed("source", "_s")
    return left.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with its own columns."""
    plan = mix_plan(docs, id_col, text_col, source_col, **options).where("copies > 0")
    p = private(docs)
    names = {"doc_id": "id", "source": "source", "key": "key", "copies": "copies"}
    plan = plan.select(*[F.col(c).alias(f"{p}{n}") for c, n in names.items()])
    d = docs.withColumn(f"{p}k", content_key(id_col, text_col))
    same = F.col(id_col).eqNullSafe(F.col(f"{p}id")) & F.col(source_col).eqNullSafe(F.col(f"{p}source")) & (F.col(f"{p}k") == F.col(f"{p}key"))
    out = d.join(plan, same).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies"))))
    return out.select(*docs.columns)
