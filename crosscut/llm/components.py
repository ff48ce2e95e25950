"""Connected components of a graph of links, by contraction.

Each round every node points to its smallest neighbour or itself, pointers are followed to their roots by doubling, and
the links are rewritten to roots; links within a root and repeated links go. Rounds are few (each at least halves the
nodes that still have links), all tables stay distributed, and each is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _table(df: DataFrame) -> DataFrame:
    """df as a written table, whose size the planner knows: a checkpoint would carry the product of its inputs' sizes."""
    return saved(df, "components")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) for every id that has a link; nulls and loops are ignored."""
    left = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    left = _table(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while left.take(1):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = _table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")))
        while True:  # to: strictly smaller than id or a root, so following it ends
            hop = point.select(F.col("id").alias("to"), F.col("to").alias("far"))
            further = point.join(hop, "to").select("id", "to", "far")
            further = _table(further)
            moved = further.filter("far <> to").take(1)
            point = further.select("id", F.col("far").alias("to"))
            if not moved:
                break
        if label is None:
            label = point.select("id", F.col("to").alias("component"))
        else:
            step = point.select(F.col("id").alias("component"), "to")
            label = _table(label.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        ends = point.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        left = left.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").filter("ra <> rb")
        left = _table(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if label is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return label


def joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """The components after further links (a, b) between nodes that comps (id, component) may not have."""
    of = comps.select(F.col("id").alias("a"), F.col("component").alias("ra"))
    ends = more.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left")
    top = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).withColumnRenamed("component", "to")
    old = comps.join(top.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    new = top.join(comps.select("id"), "id", "left_anti").select("id", F.col("to").alias("component"))
    return _table(old.unionByName(new))
