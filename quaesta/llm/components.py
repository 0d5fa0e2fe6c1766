"""Connected components over edge tables, by alternating large-star and small-star rounds.

Each round is two grouped minima (combined before the shuffle) and two equi-joins
against one row per node, so a hub with a third of all edges is split by AQE instead
of landing in one task. Rounds end in a table in shared storage. A set of stars needs
one round, a path a number logarithmic in its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every id on an edge; component is the smallest id reachable.

    Ids are longs. Edges with a null end or equal ends are ignored; an id without any
    other edge is then not returned. Repeated edges count once; no edges give no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = written(e.where("u <> v").distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour of a node moves to the smallest id around that node
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
