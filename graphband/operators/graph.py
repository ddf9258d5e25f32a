"""Node graphs of matrices, heavy-edge matching and contraction.

Edges are (u, v, w) with u < v; nodes are (id, c) with their weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphband.session import discard, materialise


def matrix_to_graph(entries: DataFrame, d: int) -> DataFrame:
    """Edges by summed magnitudes of the d x d blocks in both directions; no loops, no zeros."""
    u, v = F.expr(f"i div {d}"), F.expr(f"j div {d}")
    e = entries.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.abs("v").alias("w")).where("u <> v")
    return e.groupBy("u", "v").agg(F.sum("w").alias("w")).where("w <> 0")


def node_weights(entries: DataFrame, n: int, d: int) -> DataFrame:
    """Signed sums of the diagonal over each node's rows, 0 where there is none; all n / d nodes."""
    sums = entries.where("i = j").groupBy(F.expr(f"i div {d}").alias("id")).agg(F.sum("v").alias("c"))
    return entries.sparkSession.range(n // d).join(sums, "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("c"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends."""
    return edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("deg"))


def weight_cap(nodes: DataFrame, k: int) -> DataFrame:
    """1.5 times an even share of all weight."""
    return nodes.agg((F.lit(1.5) * F.sum("c") / k).alias("cap"))


def score(strategy: str) -> Column:
    """How much a candidate edge attracts, by strategy, of columns w, cu, cv."""
    w = F.abs("w")
    if strategy in ("random", "sorted"):
        return w
    if strategy == "light":
        return -w
    if strategy == "modified":
        return F.when((F.col("cu") > 0) & (F.col("cv") > 0), w / F.sqrt(F.col("cu") * F.col("cv"))).otherwise(w)
    raise ValueError(f"unknown strategy {strategy!r}")


def candidates(edges: DataFrame, nodes: DataFrame, strategy: str = "modified", cap: float | None = None) -> DataFrame:
    """Eligible candidates (u, v, w, score, tie) from each side; ties are the same from both."""
    cu, cv = nodes.select(F.col("id").alias("u"), F.col("c").alias("cu")), nodes.select(F.col("id").alias("v"), F.col("c").alias("cv"))
    e = symmetric(edges).join(cu, "u").join(cv, "v")
    if cap is not None:
        e = e.where(F.col("cu") + F.col("cv") <= cap)
    tie = (F.least("u", "v") * 31 + F.greatest("u", "v") * 17) % 1009
    return e.select("u", "v", "w", F.round(score(strategy), 9).alias("score"), tie.alias("tie"))


def best_candidates(found: DataFrame) -> DataFrame:
    """The best neighbour of each node: by score, magnitude, tie, ids."""
    return found.groupBy("u").agg(F.max_by("v", _key()).alias("v"))


def mutual_round(found: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that are each other's best."""
    return mutual(best_candidates(found))


def mutual(best: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of (u, v) that choose each other."""
    back = best.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return best.join(back, ["u", "v"]).where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))


FEW = 1 << 18  # candidates, of both sides, that one task may match


def _key() -> Column:
    """What makes a candidate better than another: score, magnitude, tie, ids."""
    return F.struct("score", F.abs("w").alias("m"), F.col("tie").alias("t"), F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))


def _greedy(left: DataFrame, *order: Column | str) -> DataFrame:
    """Pairs (u, v) of a pass over few candidates in that order, by one task: a pair stands where both ends are still free."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[int] = set()
        for b in batches:
            pairs = []
            for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
                if u not in taken and v not in taken:
                    taken.update((u, v))
                    pairs.append((u, v))
            yield pd.DataFrame(np.array(pairs, np.int64).reshape(-1, 2), columns=["u", "v"])

    return left.repartition(1).sortWithinPartitions(*order).select("u", "v").mapInPandas(run, "u long, v long")


def matching(edges: DataFrame, nodes: DataFrame, strategy: str = "modified", cap: float | None = None, few: int = FEW) -> DataFrame:
    """A maximal matching (id, mate) by rounds of mutual best; unmatched nodes are their own mates.

    The best eligible edge is always mutual, so each round matches something.
    The rounds come to the pass over all edges, best first, with which one task
    ends once no more than ``few`` candidates are left.
    """
    left, found = materialise(candidates(edges, nodes, strategy, cap)), []
    while (n := left.count()) > few:
        best = materialise(best_candidates(left))
        pairs = materialise(mutual(best))
        taken = pairs.select(F.explode(F.array("a", "b")).alias("x"))
        rest = left.join(taken.withColumnRenamed("x", "u"), "u", "left_anti").join(taken.withColumnRenamed("x", "v"), "v", "left_anti")
        found.append(pairs.toDF("u", "v"))
        before, left = left, materialise(rest)
        discard(before, best)
    if n:
        found.append(materialise(_greedy(left.where("u < v"), F.desc(_key()))))
    discard(left)
    return _mates(nodes, found)


def visit_matching(edges: DataFrame, nodes: DataFrame, strategy: str = "modified", cap: float | None = None, seed: int = 0, few: int = FEW) -> DataFrame:
    """The matching (id, mate) of a greedy pass that visits nodes in ``visit_order`` and takes the best neighbour still free; others are their own mates.

    Deterministic reservations: each node has a bound, the place in the order
    before which it is surely free.  A visit takes the node itself, or one of
    its neighbours, best first: one comes into question only where all better
    ones may be gone by then, by their bounds.  So a node's bound is the first
    place among its own and those of the visits for which it comes into
    question, and bounds grow from round to round.  A node's pick of its best
    free neighbour stands where both are surely free at its place.  The rounds
    end in the same matching as one visit after another, whatever the
    partitions; one task does that once no more than ``few`` candidates are left.
    """
    places = materialise(visit_order(edges, nodes, strategy, seed).select("id", "place"))
    left = candidates(edges, nodes, strategy, cap)
    for end in ("u", "v"):
        left = left.join(places.select(F.col("id").alias(end), F.col("place").alias(f"at_{end}")), end)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc(_key()))))
    left, found = materialise(left.select("u", "v", "at_u", "at_v", "rank", (F.col("rank") == 1).alias("top"), F.lit(True).alias("open"))), []
    by_u = Window.partitionBy("u")
    while (n := left.count()) > few:
        bounds = materialise(left.where("open").groupBy(F.col("v").alias("id")).agg(F.min("at_u").alias("bound")))  # its own place counts, too
        of = lambda end, bounds=bounds: bounds.select(F.col("id").alias(end), F.col("bound").alias(f"bound_{end}"))
        free = lambda end: F.coalesce(F.least(f"bound_{end}", f"at_{end}"), F.col(f"at_{end}")) >= F.col("at_u")
        picks = left.where("top").join(of("u"), "u", "left").join(of("v"), "v", "left").where(free("u") & free("v"))
        pairs = materialise(picks.select("u", "v"))
        found.append(pairs)
        taken = pairs.select(F.explode(F.array("u", "v")).alias("x"))
        rest = left.join(taken.withColumnRenamed("x", "v"), "v", "left_anti").join(of("v"), "v", "left").join(taken.withColumnRenamed("x", "u"), "u", "left_anti")
        last = F.min(F.when(free("v"), F.col("rank"))).over(by_u)  # what comes after it is out of the question
        rest = rest.select("u", "v", "at_u", "at_v", "rank", (F.col("rank") == F.min("rank").over(by_u)).alias("top"), F.coalesce(F.col("rank") <= last, F.lit(True)).alias("open"))
        before, left = left, materialise(rest)
        discard(before, bounds)
    if n:
        found.append(materialise(_greedy(left, "at_u", "rank")))
    discard(left, places)
    return _mates(nodes, found)


def _mates(nodes: DataFrame, found: list[DataFrame]) -> DataFrame:
    """(id, mate) of pairs (u, v); other nodes are their own mates."""
    if not found:
        return nodes.select("id", F.col("id").alias("mate"))
    pairs = reduce(DataFrame.unionAll, found)
    ends = pairs.select(F.col("u").alias("id"), F.col("v").alias("mate")).unionAll(pairs.select(F.col("v").alias("id"), F.col("u").alias("mate")))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("mate", "id").alias("mate"))


#: How a level is matched: by rounds of mutual best, or as a pass in visit order does.
MATCHINGS = {"mutual": lambda edges, nodes, strategy, cap, seed: matching(edges, nodes, strategy, cap), "visit": visit_matching}


def ranked(rows: DataFrame, by: str | list[str], name: str, step: Column | None = None, kind: str = "long") -> DataFrame:
    """``rows`` with a column of how many rows come before, by ``by`` (or the sum of their ``step``, a ``kind``).

    Ranges are numbered side by side and shifted by the sums before them, so
    that no task sees all rows.
    """
    by = [by] if isinstance(by, str) else by
    step = F.lit(1) if step is None else step
    parts = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()))
    before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.groupBy("part").agg(F.sum(step).alias("n"))  # a row for each range
    shift = shift.select("part", before("n", Window.orderBy("part")).alias("before"))
    own = parts.withColumn("own", before(step, Window.partitionBy("part").orderBy(*by)))
    return own.join(shift, "part").select(*rows.columns, (F.col("own") + F.col("before")).cast(kind).alias(name))


def supernodes(mates: DataFrame) -> DataFrame:
    """(id, coarse): pairs are numbered in the order of their smaller members."""
    numbered = ranked(mates.where("id <= mate").select(F.col("id").alias("lead")), "lead", "coarse")
    return mates.select("id", F.least("id", "mate").alias("lead")).join(numbered, "lead").select("id", "coarse")


def contract_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("id").alias("u"), F.col("coarse").alias("x")), labels.select(F.col("id").alias("v"), F.col("coarse").alias("y"))
    e = edges.join(a, "u").join(b, "v").where("x <> y")
    return e.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.sum(F.abs("w")).alias("w"))


def contract_nodes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "id").groupBy(F.col("coarse").alias("id")).agg(F.sum("c").alias("c"))


def visit_order(edges: DataFrame, nodes: DataFrame, strategy: str, seed: int = 0) -> DataFrame:
    """(id, deg, place): ``sorted`` visits nodes by weighted degree, largest first; other strategies in an order drawn by hash."""
    n = nodes.join(weighted_degrees(edges), "id", "left").select("id", F.coalesce("deg", F.lit(0.0)).alias("deg"))
    key = -F.col("deg") if strategy == "sorted" else F.xxhash64(F.lit(seed), "id").cast("double")
    return ranked(n.withColumn("key", key), ["key", "id"], "place").drop("key")


def level_row(level: int, edges: DataFrame, nodes: DataFrame, before: int | None, inferior: int, superior: int | None, accepted: bool) -> dict:
    """What a coarsening preview says of a level."""
    c = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).first()
    n = c["n"]
    return {
        "level": level, "nodes": n, "edges": edges.count(), "reduction_ratio": round(n / before, 4) if before else 1.0,
        "min_weight": round(c["least"] or 0.0, 2), "max_weight": round(c["most"] or 0.0, 2),
        "in_target_range": n >= inferior and (superior is None or n <= superior), "accepted": accepted,
    }


LEVEL = "level long, nodes long, edges long, reduction_ratio double, min_weight double, max_weight double, in_target_range boolean, accepted boolean"


@dataclass
class Chain:
    """Graphs from fine to coarse, the maps (id, coarse) between them, why coarsening ended, and what each level tried was like."""

    graphs: list[tuple[DataFrame, DataFrame]]
    maps: list[DataFrame]
    reason: str
    reachable: bool
    levels: list[dict]


def chain(edges: DataFrame, nodes: DataFrame, inferior: int, superior: int | None, strategy: str = "modified", cap: float | None = None, ratio: float = 0.99, max_levels: int = 30, rule: str = "mutual", seed: int = 0) -> Chain:
    """Coarsens until the rules stop it, whether or not the size asked for is reached.

    ``rule`` names the matching in MATCHINGS.  ``max_levels`` counts the first graph.  A level below ``inferior`` is
    refused; one that is not above ``superior`` ends the chain whatever its
    ratio; one that does not shrink, or by less than ``ratio`` asks, is refused.
    """
    if inferior < 1 or (superior is not None and superior < inferior):
        raise ValueError("sizes must satisfy 1 <= inferior <= superior")
    row = lambda *x: level_row(*x[:4], inferior, superior, x[4])
    out = Chain([(edges, nodes)], [], "", False, [row(0, edges, nodes, None, True)])
    n = out.levels[0]["nodes"]
    if superior is not None and inferior <= n <= superior:
        out.reason = "the first graph is in range"
    while not out.reason and n > inferior and len(out.graphs) < max_levels:
        e, c = out.graphs[-1]
        labels = materialise(supernodes(MATCHINGS[rule](e, c, strategy, cap, seed)))
        coarse = materialise(contract_nodes(c, labels))
        links = materialise(contract_edges(e, labels))
        m, level = coarse.count(), len(out.graphs)
        if m < inferior:
            out.reason = f"level {level} would fall below the least size ({m} < {inferior})"
        elif superior is not None and m <= superior:
            out.reason = f"level {level} is in range"
        elif m >= n:
            out.reason = f"level {level} does not shrink"
        elif m / n > ratio:
            out.reason = f"level {level} shrinks to {m / n:.3f} only"
        taken = not out.reason or out.reason.endswith("in range")
        out.levels.append(row(level, links, coarse, n, taken))
        if taken:
            out.graphs.append((links, coarse))
            out.maps.append(labels)
            n = m
    out.reachable = n >= inferior and (superior is None or n <= superior)
    out.reason = out.reason or (f"{n} nodes reached" if out.reachable else f"{n} nodes after {len(out.graphs)} levels")
    return out


def coarsen(edges: DataFrame, nodes: DataFrame, inferior: int, superior: int | None, strategy: str = "modified", cap: float | None = None, ratio: float = 0.99, max_levels: int = 30) -> tuple[list[tuple[DataFrame, DataFrame]], list[DataFrame]]:
    """The graphs and maps of ``chain``; raises where ``superior`` is set and the last level is outside."""
    out = chain(edges, nodes, inferior, superior, strategy, cap, ratio, max_levels)
    if superior is not None and not out.reachable:
        raise ValueError(f"{out.levels[-1]['nodes']} nodes are not within [{inferior}, {superior}]: {out.reason}")
    return out.graphs, out.maps
