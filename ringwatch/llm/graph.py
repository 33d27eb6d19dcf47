"""Classes of equal rows and connected components, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.common import saved


def classes(df: DataFrame, keys: list[str], item: str, name: str = "class_id") -> DataFrame:
    """``df`` with ``name``: the smallest ``item`` among the rows with equal ``keys``.

    Keys that hold at least a thousandth of all rows (so at most a thousand keys) are matched by a
    broadcast; only the others meet in a shuffle. Rows with a null key are classes of their own.
    """
    total = df.count()
    seen = df.groupBy(*keys).agg(F.min(item).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    for k in keys:
        seen = seen.where(F.col(k).isNotNull())
    seen = saved(seen, "classes")
    hot = max(200, total // 1000)
    many = F.broadcast(seen.where(F.col("_n") >= hot).select(*keys, F.col("_least").alias("_hot")))
    few = seen.where(F.col("_n") < hot).select(*keys, "_least")
    marked = df.join(many, keys, "left")
    rest = marked.where("_hot is null").join(few, keys, "left")
    columns = df.columns
    return (
        marked.where("_hot is not null").select(*columns, F.col("_hot").alias(name))
        .unionByName(rest.select(*columns, F.coalesce("_least", item).alias(name)))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) edges; component is its smallest node.

    Each round every node takes the least label among itself and its neighbours, then the label
    of its label, so that the distance still to cover about halves; it ends when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = saved(both, "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        low = labels.join(heard, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("low"))
        low = saved(low, "low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("further"))
        new = saved(low.join(jump, "low", "left").select("node", "old", F.coalesce(F.least("low", "further"), "low").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
