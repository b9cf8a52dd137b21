"""Connected components of a table of links, as DataFrame joins with a written table after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import release, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b), of any type with an order, -> (node, root): root is the smallest node of node's component; only linked nodes have a row.

    Each round takes the smallest label among the neighbours, hooks it to the old label's node and jumps to the label's label;
    the number of rounds grows with the logarithm of a component's diameter. All sums are minima, combined before the exchange,
    so a hub is no hot task. Null ends and links of a node to itself are left out."""
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        t = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        hook = t.groupBy("old").agg(F.min("new").alias("hook")).withColumnRenamed("old", "node")
        hooked = written(t.join(hook, "node", "left").select("node", "old", F.least("new", F.coalesce("hook", "new")).alias("new")), "hooked")
        release(labels)
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        t = written(hooked.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("jump", "new")).alias("root")), "labels")
        release(hooked)
        labels = t.select("node", "root")
        if t.where("old <> root").isEmpty():
            release(both)
            return labels
