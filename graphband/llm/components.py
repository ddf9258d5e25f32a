"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.session import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the component's smallest id) of every node with an edge; edges have long columns a and b.

    Rounds of contraction: each node points to its smallest neighbour (or to
    itself), pointers are followed once more, and edges are drawn anew between
    what their ends point to.  Edges within what has become one node are
    dropped, so that a star is gone after the first round.  Each round is
    written to the shared folder.  A null end or an edge from a node to itself
    counts for nothing.
    """
    left = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = table = None  # the table behind labels
    while not left.isEmpty():
        ends = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to")))
        far = near.select(F.col("id").alias("to"), F.col("to").alias("far"))
        to = materialise(near.join(far, "to").select("id", F.col("far").alias("to")))
        discard(near)
        if labels is None:
            labels, table = to.withColumnRenamed("to", "comp"), to
        else:
            on = to.select(F.col("id").alias("comp"), "to")
            new = materialise(labels.join(on, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
            discard(table)
            labels = table = new
        moved = left
        for end in ("a", "b"):
            moved = moved.join(to.select(F.col("id").alias(end), F.col("to").alias(f"to_{end}")), end)
        moved = moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        rest = materialise(moved.distinct())
        discard(left, None if table is to else to)
        left = rest
    return left.select(F.col("a").alias("id"), F.col("b").alias("comp")) if labels is None else labels


def extend(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) of components with further links (a, b): only what they join is worked on."""
    at = {e: labels.select(F.col("id").alias(e), F.col("comp").alias(f"comp_{e}")) for e in ("a", "b")}
    ends = links.join(at["a"], "a", "left").join(at["b"], "b", "left")
    ends = materialise(ends.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b").distinct())
    if ends.isEmpty():
        return labels
    more = components(ends)
    new = more.join(labels.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp"))
    on = more.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return materialise(labels.unionAll(new).join(on, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
