"""Connected components over links, as label propagation with shortcuts; links and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component.

    Every round each node takes the smallest label among its neighbours' and then its label's label, so that the
    longest path to the root is cut to a fraction; the loop ends when no label changes.
    """
    both = common.sized(common.store(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionAll(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .where(F.col("u") != F.col("v"))
    ))
    first = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node")
    labels = common.sized(common.store(first))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        moved = labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root")
        )
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("up"))
        moved = common.sized(common.store(
            moved.join(up, moved["root"] == up["at"], "left").select(
                "node", "was", F.least("root", F.coalesce("up", "root")).alias("root")
            )
        ))
        changed = moved.where(F.col("root") != F.col("was")).limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels
