"""Connected components by alternating large and small stars.

Every round replaces the edge table by one whose edges point nearer to the smallest node of their
component, until the table is a set of stars. Each step is a minimum per node, which is combined on
the map side, and a join back. The join's two sides are exchanged for the join alone, so that
adaptive execution can split the partition of a hub that most edges meet in. Rounds grow with the
logarithm of a component's diameter; their tables are written to the shared folder and the previous
one is dropped. The rounds end as soon as the table is a set of stars: every node has one edge, and none
leads to a node that has one itself. Nothing is collected but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinsift.storage import discard, materialize


def _joined(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and of every v of the same u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # The sum keeps the aggregate's own exchange from serving the join: see the module's docstring.
    least = least.select((F.col("u") + F.lit(0)).alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs.u == least.w).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _joined(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return _joined(edges).select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    rows, nodes = edges.agg(F.count("*"), F.countDistinct("u")).first()
    if rows > nodes:
        return False
    ends = edges.select(F.col("v").alias("w")).distinct()
    return edges.join(ends, edges.u == ends.w, "left_semi").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node that an edge to another node names.

    component is the smallest node reachable. Edges with a null end or with equal ends join nothing;
    repeated and reversed edges count once; an empty table gives an empty result. Node ids are longs.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    current = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    current = materialize(current.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(current):
            break
        following = materialize(_small_star(_large_star(current)), "stars")
        discard(current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
