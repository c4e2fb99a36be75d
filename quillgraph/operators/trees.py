"""Trees of sections: roll-ups over parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def rollup(nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(id, n): counts own(id, n) summed over each node's subtree; nodes(id, parent); empty subtrees are left out.

    Ancestors are found by joins up the tree, a round for each level to the root; levels are checkpointed. Raises
    where a node is its own ancestor.
    """
    up = nodes.select("id", F.col("parent").alias("up"))
    step = nodes.select("id", F.col("id").alias("ancestor"))
    whole = step
    while True:
        step = checkpointed(step.join(up.select(F.col("id").alias("ancestor"), "up"), "ancestor").where("up is not null").select("id", F.col("up").alias("ancestor")))
        if step.isEmpty():
            break
        if not step.where("id = ancestor").isEmpty():
            raise ValueError("the tree has a cycle")
        whole = whole.union(step)
    return whole.join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("n")).where("n > 0")
