"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.tables import written


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node.

    Each round every node passes the smallest neighbour it knows to its larger
    neighbours, then to its smaller ones; edges shrink to stars around the
    smallest node.  The rounds needed grow with the logarithm of the longest
    path.  Neighbour sets are only folded to minima, never gathered, and each
    round is written out.
    """
    kind = edges.schema["a"].dataType
    links = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = _mark(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        joined = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        links = written(joined.distinct(), "edges")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    own = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own).select(
        F.col("node").cast(kind), F.col("component").cast(kind)
    )


def _mark(links: DataFrame) -> tuple:
    """Tells two edge sets apart: count and a sum of hashes."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
