"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm._common import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b: long) -> (id, label): for each id in a link, the smallest id that it reaches.

    Rounds contract the graph: every id points at its smallest neighbour, if that
    is smaller; pointers are followed four steps; links then join what their ends
    point at, and those within one id vanish. At least half of the ids that are
    not alone vanish too, so rounds grow with the logarithm of their number, and
    the links shrink with every round. Each round is a written table. An empty
    link table gives an empty result; self links and null ids count for nothing.
    """
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = written(ordered(links.select("a", "b").dropna()), "edges")
    labels = None
    while True:
        near = edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        points = near.select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        for _ in range(2):
            points = points.join(points.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))
        points = written(points, "points")
        if labels is None:
            labels = written(points.select("id", F.col("to").alias("label")), "labels")
        else:
            moved = labels.join(points.select(F.col("id").alias("label"), "to"), "label", "left")
            labels = written(moved.select("id", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = edges.join(points.select(F.col("id").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        edges = written(ordered(edges), "edges")
        if edges.isEmpty():
            return labels
