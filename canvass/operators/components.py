"""Connected components as DataFrame joins (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.sources.shared import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns ``node``, ``component``.

    Each round links every node to the smallest node it knows, first through its larger and
    then through its smaller neighbours; the number of rounds grows with the logarithm of a
    component's diameter. Rounds are cut by tables in the shared folder, so a lost executor
    costs one round at most. Hub nodes are only ever reduced with map-side minima and met
    again in joins that adaptive execution can split.

    Edges with a null end and self-loops link nothing: a self-loop's node is returned as its
    own component. Repeated and mirrored edges count once. An empty table gives an empty one.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    alone = pairs.select(F.col("u").alias("node")).distinct()
    ends = alone.union(pairs.select("v")).distinct()
    links = stored(_larger_first(pairs), "links")
    mark = _mark(links)
    for _ in range(max_rounds):
        links = stored(_small_star(_large_star(links)), "links")
        was, mark = mark, _mark(links)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return ends.join(links.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def _larger_first(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _larger_first(low.select("u", F.col("m").alias("v")).union(moved))
