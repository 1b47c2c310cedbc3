"""Connected components of an edge table, by least labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each node's component; only nodes with edges.

    In a round every node takes the least label among its neighbours and its
    own, then that label's label. The steps combine before they shuffle.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = cut(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node != other").distinct())
    labels = cut(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        taken = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = taken.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = taken.join(up, F.col("label") == F.col("_n"), "left")
        after = cut(jumped.select("node", "was", F.least("label", F.coalesce("_up", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("was != label").isEmpty():
            return labels
