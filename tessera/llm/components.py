"""Connected components over an edge table, without gathering edges anywhere.

Each round points every node at its smallest neighbour, follows the pointers to their ends by doubling, and
contracts the edges onto these ends. Pointers only ever go to smaller ids, so the end of each chain is the
smallest node that it reaches, and after the last round the smallest of the component. Hubs are met by
map-side combined minima and by joins that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, pieces, written


#: Edges or nodes that one file of a round's tables holds, at about.
ROWS = 250_000


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """edges (a long, b long), any direction, repeats and loops allowed -> (node, root) for every node that isn't the smallest
    of its component, which is its root. Nulls join nothing. most: an upper bound of how many edges there are, where one is known. An empty table gives an empty table.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    files = pieces(most, ROWS, 8) if most else None
    e = written(e, "edges", files)
    files = pieces(2 * e.count(), ROWS, 8)  # no round has more nodes or edges than the first
    labels = None
    while not e.isEmpty():
        p = written(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "parent", files)
        while True:
            up = p.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            q = written(p.join(up, p.root == up.mid, "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "jump", files)
            moved = not q.where("moved").isEmpty()
            drop_written(p)
            p = q.select("node", "root")
            if not moved:
                break
        labels = p if labels is None else written(
            labels.join(p.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(p), "labels", files)
        to = lambda side: p.select(F.col("node").alias(side), F.col("root").alias(f"{side}_top"))
        n = e.join(to("hi"), "hi", "left").join(to("lo"), "lo", "left").select(F.coalesce("hi_top", "hi").alias("x"), F.coalesce("lo_top", "lo").alias("y"))
        n = written(n.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges", files)
        drop_written(e)
        e = n
    if labels is None:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return labels
