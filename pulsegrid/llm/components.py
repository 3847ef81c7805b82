"""Connected components by repeated contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the smallest node of its component) of every node of ``edges`` (a, b: long).

    Every round maps each node to its smallest neighbour or itself, and the edges to the images of
    their ends; a star collapses in one round, and with node numbers that are hashes the number of
    rounds grows with the logarithm of a component's width. Joins are by the node of the larger end
    first and never by label, so no key of a large component gathers it. Tables between rounds are
    written to the shared folder and deleted once the next round has read them. Self-links, repeated
    and null edges have no effect; no edges give no rows.
    """
    left = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        step = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), name)
        maps.append(step)
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        after = written(moved.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), name)
        drop(left)
        left = after
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    drop(left)
    labels = maps[-1].select("node", F.col("to").alias("label"))
    labels._written_at = maps[-1]._written_at
    for step in reversed(maps[:-1]):
        later = labels.select(F.col("node").alias("to"), "label")
        after = written(step.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label")), name)
        drop(step, labels)
        labels = after
    return labels
