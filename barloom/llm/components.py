"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> node, component: the smallest node that each node reaches.

    Every round gives each node the smallest label among its neighbours and itself, and then
    that label's own label, so long paths shrink by jumps.  Labels only fall; a round in which
    their sum stays is the last.  Each round's table is written to the shared folder.  Nodes
    without links have no row; no links give no rows.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), "edges")
    labels = stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    before = None
    while True:
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before or total is None:
            discard(edges)
            return labels
        before = total
        seen = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.least("component", "near").alias("component"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        jumped = nearer.join(own, "component", "left").select("node", F.least("component", "jump").alias("component"))
        nearer = stored(jumped, "labels")
        discard(labels)
        labels = nearer


def grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) with the components that further ``links`` (a, b) join."""
    ends = links
    for end in ("a", "b"):
        own = found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce(f"{end}_component", end)).drop(f"{end}_component")
    joined = components(ends.filter("a <> b"))
    known = found.join(joined.toDF("component", "reached"), "component", "left").select("node", F.coalesce("reached", "component").alias("component"))
    out = stored(known.union(joined.join(found, "node", "left_anti")), "components")
    discard(joined)
    return out
