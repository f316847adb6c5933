"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import Work

#: Rounds double the distance that a label travels; this many reach any graph there is.
MAX_ROUNDS = 64


def components(edges: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (two columns ``a``, ``b``).

    ``component`` is the smallest node reachable. Alternates large-star and
    small-star steps (Kiveris et al., 2014): each turns every neighbourhood into
    a star around its minimum, so a hub costs as many rows as it has neighbours
    and never their pairs. Each round is written to the shared folder; it ends
    when a round leaves the edges as they were. Nodes without an edge to another
    node are not returned, repeated edges and loops are harmless, an empty table
    gives an empty table.
    """
    now = work.table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{name}-0",
    )
    before = None
    for k in range(1, MAX_ROUNDS):
        large = _star(now.union(now.select("b", "a")), lambda v, u: v > u)
        after = work.table(_star(large, lambda v, u: v <= u, keep_own=True), f"{name}-{k}")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{k - 1}")
        now = after
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _star(pairs: DataFrame, linked, keep_own: bool = False) -> DataFrame:
    """Links the neighbours ``b`` of each ``a`` (those that ``linked`` admits) to the least of them and ``a``."""
    if keep_own:  # small star: neighbours below the node, and the node itself
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    if keep_own:
        joined = joined.select("b", "m").union(least.select("a", "m"))
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.where(linked(F.col("b"), F.col("a"))).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
