"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import dropped, joined_hot, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Each round every node hooks onto the neighbour (or itself) whose hash is smallest, and
    the edges are rewritten between the hooks. One end of every edge takes a smaller hash
    each round; a star is done in two, and hashes have no long descending chains, so
    rounds are few. Every round is a written
    table; nothing is collected. A node with very many edges costs no single task: minima
    are taken map-side first and the joins are plain ones that Spark can split. Edges with
    a null end or equal ends are ignored.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    maps: list[DataFrame] = []
    while not now.isEmpty():
        near = now.select(F.col("a").alias("node"), F.col("b").alias("other")).union(now.select("b", "a"))
        best = near.groupBy("node").agg(F.min(F.struct(F.xxhash64("other").alias("h"), F.col("other").alias("hook"))).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("hook"))
        hooks = written(best.select("node", F.least("m", own)["hook"].alias("hook")))
        left, right = hooks.toDF("a", "ha"), hooks.toDF("b", "hb")
        nxt = written(now.join(left, "a").join(right, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")).where("a <> b").distinct())
        dropped(now)
        maps.append(hooks)
        now = nxt
    dropped(now)
    if not maps:
        kind = edges.schema[a].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    roots = maps[-1].toDF("node", "root")
    for hooks in reversed(maps[:-1]):
        roots = hooks.join(roots.withColumnRenamed("node", "hook"), "hook", "left").select("node", F.coalesce("root", "hook").alias("root"))
    roots = written(roots)
    smallest = written(roots.groupBy("root").agg(F.min("node").alias("low"), F.count("*").alias("n")))
    out = written(joined_hot(roots, smallest, "root").select("node", F.col("low").alias("root")))
    dropped(roots, smallest, *maps)
    return out
