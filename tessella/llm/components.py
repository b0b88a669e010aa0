"""Connected components of an edge table by alternating star contraction, all in DataFrames.

Each round every node's neighbours are tied to the smallest one it sees (large star), then the smaller ones among
themselves (small star); edges never multiply. Rounds go on until the edge set is a forest of stars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import discard, written


def _again(node: str, kind: T.DataType) -> Column:
    """The same node (a long, or a struct of longs and flags) as a new expression; see common.apart."""
    c, zero = F.col(node), F.lit(0).cast("long")
    if not isinstance(kind, T.StructType):
        return c + zero
    return F.struct(*[(c[f.name] + zero if f.dataType == T.LongType() else c[f.name]).alias(f.name) for f in kind])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): one round of a star. Minima are pre-aggregated before the join, which may split a hub's rows."""
    kind = edges.schema["a"].dataType
    pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # a > b in a small star: ties a node's smaller neighbours to the least of them
    least = pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
    tied = pairs.join(least.select(_again("a", kind).alias("k"), "m"), F.col("a") == F.col("k"))
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Edges of a partition of a round's table, and its partitions at least: a small forest needn't be dealt to every task.
PART_ROWS, PARTS = 20_000, 8


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges: two columns of one type, long or a struct (ordered by its fields, whose nulls come first); loops, repeats and null
    nodes are dropped. An empty table gives an empty one.
    """
    x, y = edges.columns
    e = edges.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    e = written(e.distinct(), "edges")
    rows, mark = e.count(), None
    for _ in range(max_rounds):
        # edges never multiply, so the first count bounds all rounds'
        last, e = e, written(_star(_star(e, True), False).coalesce(max(PARTS, rows // PART_ROWS)), "edges")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = tuple(now)
    raise RuntimeError("components: the contraction did not settle")
