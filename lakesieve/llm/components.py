"""Connected components of an edge table by contraction.

Every round maps each node with edges to the first among itself and its neighbours, and relabels the edges by that map, until none
is left. First by id in even rounds, which ends stars in two; by a hash of id and round in odd ones, by which chains shrink by a
constant factor, whatever their ids. Maps, labels and edges are written each round, so that plans stay small, nothing leaves the
executors but the number of edges, and hot nodes only meet unique rows in joins whose sides are plain tables, which adaptive
execution may split. Minima are taken before shuffling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _through(rows: DataFrame, to: DataFrame, col: str) -> DataFrame:
    """col replaced by what `to` (node, to) maps it to, where it does."""
    return rows.join(to.select(F.col("node").alias(col), "to"), col, "left").withColumn(col, F.coalesce("to", col)).drop("to")


def _tidy(edges: DataFrame) -> DataFrame:
    return stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges -> (node long, component long) for every node with an edge to another; the smallest id names it."""
    edges, labels, turn = _tidy(edges), None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        if turn % 2:
            rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
            near = both.groupBy("node").agg(F.min(rank("to")).alias("first")).select("node", F.least("first", rank("node"))["to"].alias("to"))
        else:
            near = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        near = stored(near, "near")
        labels = near.withColumnRenamed("to", "component") if labels is None else stored(_through(labels, near, "component"), "labels").select("node", "component")
        edges = _tidy(_through(stored(_through(edges, near, "a"), "edges"), near, "b"))
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = stored(labels.groupBy("component").agg(F.min("node").alias("to")).withColumnRenamed("component", "node"), "names")
    return stored(_through(labels, names, "component").select("node", "component"), "labels")


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels of components() with more edges; only what those touch is contracted again. Nodes of neither are not in the result."""
    as_map = labels.withColumnRenamed("component", "to")
    again = components(_through(stored(_through(more, as_map, "a"), "edges"), as_map, "b")).withColumnRenamed("component", "to")
    alone = again.join(labels, "node", "left_anti").select("node", F.col("to").alias("component"))
    return stored(_through(labels, again, "component").select("node", "component").unionByName(alone), "labels")
