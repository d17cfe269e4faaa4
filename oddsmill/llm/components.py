"""Connected components of a graph of longs by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(arcs: DataFrame, keep) -> DataFrame:
    """Link what each node reaches to the least of them.

    The least neighbour is aggregated first and written, so that the join
    deals the arcs of a hub anew and a hub can be split.
    """
    least = materialize(arcs.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), "star-least")
    least = least.select("c", F.least("c", "m").alias("m"))
    joined = arcs.join(least, F.col("u") == F.col("c"))
    linked = keep(joined).where("u <> v")
    out = materialize(linked.select("u", "v").distinct(), "star-edges")
    return out


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node of the component.

    Rounds grow with the logarithm of the number of nodes; each is written to
    the shared folder.  Self-loops and repeated edges do no harm.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "graph")
    mark = _print(now)
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, lambda j: j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(
            down, lambda j: j.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        )
        discard(now, large)
        now, last = small, mark
        mark = _print(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
