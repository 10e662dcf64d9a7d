"""Connected components of a graph given as pairs of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.sources.durable import durable


def rooted(edges: DataFrame) -> DataFrame:
    """node, root for every number in ``edges`` (a, b): root is the least number that can
    be reached. Alternating large-star and small-star steps: each pass hangs neighbours
    below the least one, first the larger, then the others, until nothing changes. A
    neighbourhood is never gathered: its least member is an aggregate that is joined back,
    so a node with very many neighbours is only a skewed key. Every pass is written to the
    shared folder, so its lineage is one read.
    """
    state = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "component-edges",
    )
    seen = _sign(state)
    while True:
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        state = _hung(both, F.col("b") > F.col("a"))
        state = durable(_hung(state, F.lit(True), own=True), "component-edges")
        now = _sign(state)
        if now == seen:
            # Every node hangs directly below its root.
            roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        seen = now


def _hung(pairs: DataFrame, which, own: bool = False) -> DataFrame:
    """Pairs (neighbour, least of the neighbourhood) for the neighbours chosen by
    ``which``, and for the node itself when ``own``."""
    least = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "node"))
    hung = (
        pairs.where(which)
        .join(least, F.col("a") == F.col("node"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    if own:
        hung = hung.union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def _sign(pairs: DataFrame) -> tuple:
    """Equal for equal sets of pairs."""
    return tuple(
        pairs.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            F.bit_xor(F.xxhash64("b", "a")),
        ).first()
    )
