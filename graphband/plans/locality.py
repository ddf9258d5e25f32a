"""From matrix to reordered matrix: partition, order, permute, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband.operators import graph, metrics, partition
from graphband.session import materialise
from graphband.sources import derived


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduction of bandwidth when parts are ordered by brand."""
    k, n = materialise(derived.k_part(spark, sf_dir)), derived.size(spark, sf_dir)
    moved = partition.permute(k, partition.node_order(derived.p_brand(spark, sf_dir)))
    return metrics.kpis(metrics.shape(k, n), metrics.shape(moved, n))


def fold(spark: SparkSession, sf_dir: str, d: int = 4) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of the derived matrix's graph."""
    k, n = materialise(derived.k_part(spark, sf_dir)), derived.size(spark, sf_dir)  # a self-join that both sides, and their users, would repeat
    return graph.matrix_to_graph(k, d), graph.node_weights(k, n, d)


def levels(spark: SparkSession, sf_dir: str, smallest: int = 60) -> DataFrame:
    """level, nodes, edges, min and max weight of a coarsening chain: all levels down to ``smallest`` nodes or where shrinking ends."""
    edges, nodes = fold(spark, sf_dir)
    graphs, _ = graph.coarsen(materialise(edges), materialise(nodes), smallest, None)
    out = None
    for i, (e, c) in enumerate(graphs):
        row = c.agg(F.lit(i).cast("long").alias("level"), F.count(F.lit(1)).alias("nodes"), F.min("c").alias("min_weight"), F.max("c").alias("max_weight")).join(e.agg(F.count(F.lit(1)).alias("edges")))
        out = row if out is None else out.unionByName(row)
    return out
