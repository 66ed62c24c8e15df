"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import drop_path, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge table with the smallest node that it reaches.

    Returns ``node, component``. Loops and edges with a null end name no neighbour: a node that has
    only such edges still appears, labelled with itself; nulls do not. Each round lets every node
    point its larger neighbours, then its smaller ones, at the smallest, so that components become
    stars after a number of rounds that grows with the logarithm of the path lengths. Each round is
    a written table in the shared folder, so that lost executors cost one round at most.
    """
    spark = edges.sparkSession
    given, _ = stash(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).distinct(), "edges-given")
    loops = given.where("u = v or v is null").select("u").unionAll(given.where("u is null").select("v")).where("u is not null").distinct()
    now, paths, before = given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), [], None
    for _ in range(max_rounds):
        # two 64-bit digests of the edge set, one summed and one xor-ed
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u", F.lit("mark")))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        now, path = stash(_small_star(_large_star(now)), "edges")
        paths.append(path)
        if len(paths) > 2:
            drop_path(spark, paths.pop(0))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select("component").distinct().select(F.col("component").alias("node"), "component")
    alone = loops.select(F.col("u").alias("node")).join(stars.unionAll(roots).select("node"), "node", "left_anti")
    return stars.unionAll(roots).unionAll(alone.select("node", F.col("node").alias("component")))
