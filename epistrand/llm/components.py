"""Connected components of a stored graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistrand.sources import materialize, release


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node reaches: node, component.

    ``links`` has two long columns. Each round, every node hangs itself under its smallest
    smaller neighbour; the trees that arise are flattened by pointer doubling and each is
    shrunk to its root, until no link is left between roots. Only links between different
    roots go on to the next round, and minima are taken before the shuffle, so a node may
    have any number of links. Tables of a round are written to the checkpoint folder.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = links.filter(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    edges = materialize(edges.distinct())
    nodes = edges.select(F.explode(F.array("high", "low")).alias("node")).distinct()
    found = nodes.withColumn("component", F.col("node"))
    while not edges.isEmpty():
        roots = _flatten(edges.groupBy("high").agg(F.min("low").alias("up")).withColumnRenamed("high", "node"))
        found = materialize(_lift(found, roots, "component"))
        moved = _lift(_lift(edges, roots, "high"), roots, "low").filter(F.col("high") != F.col("low"))
        ordered = moved.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low"))
        shrunk = materialize(ordered.distinct())
        release(edges)
        edges = shrunk
    return found


def _lift(rows: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Replace the nodes in a column by their roots; a node that has none is a root."""
    up = roots.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
    joined = rows.join(up, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_up", column)).select(*rows.columns)


def _flatten(tree: DataFrame) -> DataFrame:
    """From each node's parent to its root."""
    tree = materialize(tree)
    while True:
        above = tree.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        jumped = tree.join(above, F.col("up") == F.col("_node"), "left").select(
            "node", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")
        )
        jumped = materialize(jumped)
        if jumped.filter("moved").isEmpty():
            return jumped.drop("moved")
        tree = jumped.drop("moved")
