"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; each round is one grouped minimum and one equi-join on
the node, so a hub of any degree is handled by partial aggregation on one side
and AQE's skew-join split on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.lineage import cut, drop


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")


def _large(e: DataFrame) -> DataFrame:
    both = _both(e)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(id, component)``; component is the least id.

    Nodes without an edge to another node are not returned.  Null ends and
    loops are ignored; repeated edges count once.  No edges give no rows.  The
    result is a table that the caller may ``drop``.
    """
    clean = lambda d: d.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(clean(edges), "cc")
    seen = _mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = cut(clean(_small(clean(_large(now)))), "cc")
        mark = _mark(after)
        drop(now)
        now, before, seen = after, seen, mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    top = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    out = cut(now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(top), "components")
    drop(now)
    return out
