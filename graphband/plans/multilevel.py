"""The whole run: graph, coarsening, a partition of the coarsest graph, projection and refinement level by level, reordering, figures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.operators import graph, kway, metrics, partition
from graphband.session import materialise


@dataclass
class Settings:
    """Parameters of a run; ``config.settings`` makes them from a document."""

    dof: int = 1
    seed: int = 0
    inferior: int = 100
    superior: int | None = None
    max_levels: int = 30
    strategy: str = "modified"
    ratio: float = 0.99
    cap: float | None = None
    partitioner: str = "levels"
    k: int = 4
    tolerance: float = 0.1
    objective: str = "cut"
    balance: float = 0.0
    passes: int = 5
    moves: int | None = None
    matching: str = "mutual"
    refinement: str = "independent"


#: How a level is refined: moves at once that touch no other, or that do not clash; or colour after colour.
REFINEMENTS = {"independent": partition.refine, "clashes": lambda *x: partition.refine(*x, clashes=True), "colours": partition.refine_by_colours}


@dataclass
class Run:
    """What a run leaves behind."""

    settings: Settings
    n: int
    chain: graph.Chain
    coarse_part: DataFrame
    part: DataFrame
    order: DataFrame
    permuted: dict[str, DataFrame]
    figures: DataFrame = field(default=None)


def check_shapes(n: int, sizes: list[int], d: int) -> None:
    """All matrices have one size, and rows come in whole nodes."""
    if d < 1:
        raise ValueError("a node has one row at least")
    if any(x != n for x in sizes):
        raise ValueError(f"matrices of different sizes: {n}, {sizes}")
    if n % d:
        raise ValueError(f"{n} rows are not whole nodes of {d} rows")


def uncoarsen(run: graph.Chain, part: DataFrame, s: Settings, k: int) -> DataFrame:
    """The coarsest graph's partition on the first graph, refined at each level on the way; as it is where there is no map."""
    for labels, (edges, nodes) in zip(reversed(run.maps), reversed(run.graphs[:-1]), strict=True):
        part = materialise(partition.project(labels, part))
        part = REFINEMENTS[s.refinement](edges, nodes, part, k, s.tolerance, s.passes, s.objective, s.balance, s.moves)
    return part


def run(matrices: dict[str, DataFrame], n: int, s: Settings) -> Run:
    """``matrices`` by name, of n rows each; the graph is that of "K", and all are reordered by its parts."""
    check_shapes(n, [], s.dof)
    matrices = {name: materialise(m) for name, m in matrices.items()}
    stiff = matrices["K"]
    edges, nodes = materialise(graph.matrix_to_graph(stiff, s.dof)), materialise(graph.node_weights(stiff, n, s.dof))
    cap = s.cap
    if cap is None and s.k > 1:
        cap = graph.weight_cap(nodes, s.k).first()["cap"]
    chain = graph.chain(edges, nodes, s.inferior, s.superior, s.strategy, cap, s.ratio, s.max_levels, s.matching, s.seed)
    if s.superior is not None and not chain.reachable:
        raise ValueError(f"the coarsest graph is not within [{s.inferior}, {s.superior}]: {chain.reason}")
    k = kway.clamp(s.k, chain.graphs[-1][1].count())
    coarse = materialise(kway.partition(s.partitioner, *chain.graphs[-1], k, s.tolerance, s.seed))
    part = materialise(uncoarsen(chain, coarse, s, k))
    problems = partition.coverage(part, n // s.dof)
    if not problems.isEmpty():
        raise ValueError(f"the partition does not match the nodes: {[tuple(r) for r in problems.orderBy('id').limit(10).collect()]}")
    order = materialise(partition.expand(partition.node_order(part), s.dof))
    done = Run(s, n, chain, coarse, part, order, {name: materialise(partition.permute(m, order)) for name, m in matrices.items()})
    done.figures = materialise(metrics.bundle({name: (m, done.permuted[name]) for name, m in matrices.items()}, order, n, s.seed))
    return done


def summary(done: Run) -> DataFrame:
    """One row: levels, coarse and fine sizes, parts, cut before and after, bandwidth before and after."""
    edges, nodes = done.chain.graphs[0]
    cut = partition.edge_cut(edges, done.part)
    weights = partition.part_weights(nodes, done.part, done.settings.k).agg(F.max("weight").alias("heaviest_part"), F.min("weight").alias("lightest_part"))
    band = done.figures.where("matrix = 'K' AND metric = 'bandwidth'").groupBy("matrix").pivot("variant", ["original", "permuted"]).agg(F.first("value")).drop("matrix")
    last = [x for x in done.chain.levels if x["accepted"]][-1]
    one = cut.join(weights).join(band.toDF("bandwidth_original", "bandwidth_permuted"))  # one row each
    return one.select(
        F.lit(len(done.chain.graphs)).cast("long").alias("levels"), F.lit(done.n // done.settings.dof).cast("long").alias("nodes"),
        F.lit(last["nodes"]).cast("long").alias("coarse_nodes"), F.lit(last["edges"]).cast("long").alias("coarse_edges"),
        "cut", "heaviest_part", "lightest_part", "bandwidth_original", "bandwidth_permuted",
    )
