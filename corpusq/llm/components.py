"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.scratch import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(src, dst)`` of longs -> ``(node, component)``, component = smallest reachable node.

    Alternating large-star and small-star steps. Every step is a grouped minimum joined back to
    the edges, so a node with very many edges is combined before the shuffle and its join is split
    by adaptive execution; each round is written to the shared folder. Nodes without an edge are
    not returned. Nulls, loops and repeated edges are ignored. An empty table gives an empty one.
    Rounds go on until one changes nothing, which takes a number in the order of the logarithm of the nodes squared.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = materialize(e.where("u > v").distinct(), "edges")
    state, now, last = None, None, e
    while now is None or now != state:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = e.where("u > v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        before, e = last, materialize(e.select("x.u", "x.v").where("u > v").distinct(), "edges")
        discard(before)
        last = e
        state, now = now, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
