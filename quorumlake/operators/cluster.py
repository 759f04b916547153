"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.session import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge to another node.

    component is the smallest node reachable.  Null ends and self loops carry no
    link and are dropped.  Each round hooks every node to its smallest smaller
    neighbour (a map-side combined ``min``), shortens the resulting trees by
    pointer jumping and contracts the edges to their roots; edges shrink
    geometrically, and every table is written, so that a lost executor costs a
    task and not the history.  No group of edges is gathered in one place: the
    only grouped value is a minimum, the rest are equi-joins that adaptive
    execution may split.
    """
    e = written(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
                .select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")).distinct(), "edges")
    total = None
    while not e.isEmpty():
        roots = _jump(written(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks"))
        lo = roots.select(F.col("node").alias("lo"), F.col("root").alias("rlo"))
        hi = roots.select(F.col("node").alias("hi"), F.col("root").alias("rhi"))
        n = (e.join(lo, "lo", "left").join(hi, "hi", "left")
             .select(F.coalesce("rlo", "lo").alias("a"), F.coalesce("rhi", "hi").alias("b")).where("a <> b"))
        left = written(n.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
        discard(e)
        e = left
        if total is None:
            total = roots
        else:
            r = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            both = total.join(r, "root", "left").select("node", F.coalesce("up", "root").alias("root")).unionByName(roots)
            both = written(both, "labels")
            discard(total, roots)
            total = both
    if total is None:
        return e.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    low = total.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct()
    return total.select("node", F.col("root").alias("component")).unionByName(low)


def _jump(parent: DataFrame) -> DataFrame:
    """Follow ``root`` to the end of its chain by doubling."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = written(parent.join(up, "root", "left")
                       .select("node", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "jump")
        discard(parent)
        parent = step.select("node", "root")
        if step.where("moved").isEmpty():
            return parent
