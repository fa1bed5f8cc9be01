"""Connected components by minimum labels and pointer jumping, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialise


def starred(edges: DataFrame) -> DataFrame:
    """Edges (a, b), b < a, of the same components: a vertex and its smaller neighbours are tied to the least of them alone.

    Where the members of a group share neighbours, most of these ties are equal, so
    about one edge a vertex is left, however many each had.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = down.withColumn("_m", F.min("b").over(Window.partitionBy("a")))
    ties = down.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return down.select("a", F.col("_m").alias("b")).unionByName(ties).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of ``edges`` (a, b); root is the least vertex of the component."""
    stars = materialise(starred(edges), "stars")
    both = materialise(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    discard(stars)
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("root").alias("_near")).withColumnRenamed("a", "v")
        step = labels.join(near, "v").select("v", F.col("root").alias("_old"), F.least("root", "_near").alias("_r"))
        step = materialise(step, "labels")
        up = step.select(F.col("v").alias("_r"), F.col("_r").alias("_rr"))
        new = materialise(step.join(up, "_r").select("v", "_old", F.least("_r", "_rr").alias("root")), "labels")
        discard(step)
        if new.where("_old <> root").isEmpty():
            discard(both)
            return new.select("v", "root")
        labels = new.select("v", "root")
