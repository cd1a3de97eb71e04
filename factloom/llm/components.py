"""Connected components of edges between long ids, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.stages import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of an edge (a, b) with the least node of its component.

    In each round a node takes its least neighbour, chains of such choices are shortened once, and edges are rewritten to what their ends
    took, until none is left. Rounds are logarithmic in the length of a path; each reads and writes id pairs only, and minima are
    combined before the shuffle, so that a node with very many edges is no burden. Loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    live = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while not live.isEmpty():
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
        taken = written(ends.groupBy("node").agg(F.min("to").alias("to")))
        further = taken.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = written(taken.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        at = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        moved = live.join(at("a"), "a").join(at("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        live = written(moved.where("a < b").distinct())
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            labels = written(labels.join(step.select(F.col("node").alias("label"), F.col("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")
