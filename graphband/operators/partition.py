"""Quality of partitions, quadratic models of bisection, gains of moves.  A partition is (id, p)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphband.functions import guards
from graphband.operators.graph import ranked, symmetric, weighted_degrees
from graphband.session import materialise


def with_parts(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Edges with the parts pu and pv of their ends."""
    a, b = part.select(F.col("id").alias("u"), F.col("p").alias("pu")), part.select(F.col("id").alias("v"), F.col("p").alias("pv"))
    return edges.join(a, "u").join(b, "v")


def edge_cut(edges: DataFrame, part: DataFrame) -> DataFrame:
    return with_parts(edges, part).agg(F.coalesce(F.sum(F.when(F.col("pu") != F.col("pv"), F.col("w"))), F.lit(0.0)).alias("cut"))


def part_weights(nodes: DataFrame, part: DataFrame, k: int) -> DataFrame:
    """(p, weight) of parts 0..k-1, empty ones too; ids outside count as part 0."""
    nodes = nodes.select("id", guards.balance_weight(F.col("c")).alias("c"))
    p = F.when(F.col("p").between(0, k - 1), F.col("p")).otherwise(0)
    sums = nodes.join(part, "id").groupBy(p.alias("p")).agg(F.sum("c").alias("weight"))
    return nodes.sparkSession.range(k).withColumnRenamed("id", "p").join(sums, "p", "left").select("p", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def tolerance_ratio(t: float) -> float:
    """Negative is 0; above 1 it is percent."""
    return 0.0 if t < 0 else t / 100.0 if t > 1 else t


def bounds(weights: DataFrame, k: int, tolerance: float) -> DataFrame:
    """(p, weight, lower, upper): what parts may weigh."""
    t = tolerance_ratio(tolerance)
    share = weights.agg((F.sum("weight") / k).alias("share"))
    return weights.join(F.broadcast(share)).select("p", "weight", ((1 - t) * F.col("share")).alias("lower"), ((1 + t) * F.col("share")).alias("upper"))  # share is one row


def balance_violation(nodes: DataFrame, part: DataFrame, k: int, tolerance: float) -> DataFrame:
    b = bounds(part_weights(nodes, part, k), k, tolerance)
    return b.agg(F.sum(F.greatest(F.lit(0.0), F.col("lower") - F.col("weight"), F.col("weight") - F.col("upper"))).alias("violation"))


def partition_score(edges: DataFrame, nodes: DataFrame, part: DataFrame, k: int, tolerance: float, balance: float) -> DataFrame:
    """Cut and violation, each over its total, the latter times ``balance``."""
    cut, off = edge_cut(edges, part), balance_violation(nodes, part, k, tolerance)
    w, c = edges.agg(F.sum("w").alias("w")), nodes.agg(F.sum("c").alias("c"))
    one = cut.join(off).join(w).join(c)  # one row each
    return one.select((F.col("cut") / F.greatest("w", F.lit(1.0)) + F.lit(balance) * F.col("violation") / F.greatest("c", F.lit(1.0))).alias("score"))


def integer_weights(nodes: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Weights as whole numbers from 1 up: scaled where the least positive one is below 1, rounded half to even."""
    least = nodes.where("c > 0").agg(F.min("c").alias("least"))
    scale = F.when(F.col("least") < 1, 1 / F.col("least")).otherwise(1.0)
    value = F.when(F.col("least").isNull(), 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.rint(F.col("c") * scale))))
    return nodes.join(F.broadcast(least)).select("id", value.cast("long").alias("weight"))  # least is one row


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, degree, start, neighbours, weights): rows of a compressed adjacency, by id; start counts the entries of smaller ids.

    Prefix sums run side by side over ranges of ids.
    """
    s = symmetric(edges).groupBy(F.col("u").alias("id")).agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("x"))
    s = s.select("id", F.size("x").cast("long").alias("degree"), F.array_join("x.v", ",").alias("neighbours"), F.array_join(F.transform("x.w", lambda w: w.cast("long")), ",").alias("weights"))
    return ranked(s, "id", "start", F.col("degree"))


def qubo_quadratic(edges: DataFrame, nodes: DataFrame, balance: float = 1.0) -> DataFrame:
    """(u, v, q) of pairs with an edge: 2 * balance * c_u * c_v - 2 * w / scale.

    All other pairs have the first term alone, a product of two numbers of
    nodes; it is kept as the nodes' shares and never written out.
    """
    return _quadratic(edges, nodes, balance).select("u", "v", F.round("q", 9).alias("q")).where("q <> 0")


def _quadratic(edges: DataFrame, nodes: DataFrame, balance: float) -> DataFrame:
    n, scale = _shares(edges, nodes)
    a, b = n.select(F.col("id").alias("u"), F.col("share").alias("cu")), n.select(F.col("id").alias("v"), F.col("share").alias("cv"))
    e = edges.join(a, "u").join(b, "v").join(F.broadcast(scale))  # one row
    return e.select("u", "v", (2 * balance * F.col("cu") * F.col("cv") - 2 * F.col("w") / F.col("scale")).alias("q"))


def ising_couplings(edges: DataFrame, nodes: DataFrame, balance: float = 1.0) -> DataFrame:
    """(u, v, j) of pairs with an edge: a quarter of the quadratic term."""
    return _quadratic(edges, nodes, balance).select("u", "v", F.round(F.col("q") / 4, 9).alias("j")).where("j <> 0")


def _shares(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, share) of all weight and (scale): the edges' summed magnitudes; 1 where a sum is not positive."""
    positive = lambda x: F.when(x > 0, x).otherwise(1.0)
    total = nodes.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("total"))
    n = nodes.join(F.broadcast(total))  # one row
    share = F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(1.0)
    return n.select("id", share.alias("share")), edges.agg(positive(F.coalesce(F.sum(F.abs("w")), F.lit(0.0))).alias("scale"))


def qubo_linear(edges: DataFrame, nodes: DataFrame, balance: float = 1.0, target: float = 0.5) -> DataFrame:
    """(id, q): normalised degree + balance * c * (c - 2 * target), of weights as shares of their total."""
    scale = edges.agg(F.sum(F.abs("w")).alias("scale"))
    total = nodes.agg(F.sum("c").alias("total"))
    n = nodes.join(weighted_degrees(edges), "id", "left").join(F.broadcast(scale)).join(F.broadcast(total))  # one row each
    share = F.when(F.col("total") > 0, F.col("c") / F.col("total")).otherwise(1.0)
    deg = F.coalesce("deg", F.lit(0.0)) / F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    return n.select("id", F.round(deg + balance * share * (share - 2 * target), 9).alias("q"))


def boundary(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Nodes with a neighbour in another part."""
    cut = with_parts(edges, part).where("pu <> pv")
    return cut.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def connectivity(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(id, p, w): summed weight from a node to each part next to it."""
    return with_parts(symmetric(edges), part).groupBy(F.col("u").alias("id"), F.col("pv").alias("p")).agg(F.sum("w").alias("w"))


def _limits(nodes: DataFrame, part: DataFrame, k: int, tolerance: float) -> dict[str, list[float]]:
    rows = {r["p"]: r for r in bounds(part_weights(nodes, part, k), k, tolerance).collect()}
    return {c: [rows[p][c] for p in range(k)] for c in ("weight", "lower", "upper")}


def limits(nodes: DataFrame, part: DataFrame, k: int, tolerance: float) -> dict[str, Column]:
    """What parts weigh and may weigh, as arrays of k numbers for expressions: tables of k rows cost a job for each join."""
    return {c: F.array(*map(F.lit, x)) for c, x in _limits(nodes, part, k, tolerance).items()}


def move_scores(edges: DataFrame, nodes: DataFrame, part: DataFrame, k: int, tolerance: float, objective: str = "cut", balance: float = 0.0, only: DataFrame | None = None) -> DataFrame:
    """(id, source, target, gain, score) of moves to a neighbouring part that keep both parts within bounds.

    ``cut_balance`` subtracts ``balance`` times the change in the two parts'
    squared deviations from an even share; ``cut`` scores by the gain alone.
    Of equal scores both are listed.  ``only`` (id) names the nodes that may move.
    """
    return _moves(edges, nodes, part, limits(nodes, part, k, tolerance), objective, balance, only).drop("c")


def _moves(edges: DataFrame, nodes: DataFrame, part: DataFrame, b: dict[str, Column], objective: str, balance: float, only: DataFrame | None) -> DataFrame:
    """Moves with the weight c of their nodes."""
    if objective not in ("cut", "cut_balance"):
        raise ValueError(f"unknown objective {objective!r}")
    conn = connectivity(edges, part)
    if only is not None:
        conn = conn.join(only.select("id"), "id", "left_semi")
    own = part.select("id", F.col("p").alias("source")).join(nodes.select("id", guards.node_weight(F.col("c")).alias("c")), "id")
    here = F.sum(F.when(F.col("p") == F.col("source"), F.col("w"))).over(Window.partitionBy("id"))  # a row for each part next to a node
    x = conn.join(own, "id").withColumn("here", here).where("p <> source").withColumnRenamed("p", "target")
    of = lambda c, end: F.get(b[c], F.col(end))
    x = x.where((of("weight", "source") - F.col("c") >= of("lower", "source")) & (of("weight", "target") + F.col("c") <= of("upper", "target")))
    gain = F.col("w") - F.coalesce("here", F.lit(0.0))
    # (a - c - t)^2 + (b + c - t)^2 - (a - t)^2 - (b - t)^2, in which the share t cancels
    change = 2 * F.col("c") * (of("weight", "target") - of("weight", "source") + F.col("c"))
    x = x.withColumn("gain", gain).withColumn("score", gain - balance * change if objective == "cut_balance" else gain)
    return x.where("score > 0").select("id", "source", "target", "gain", "score", "c")


def best_by_score(moves: DataFrame, *more: Column) -> DataFrame:
    """Each node's best move, with more aggregates of a node's moves; the smaller part on ties."""
    best = moves.groupBy("id", "source").agg(F.max(F.struct("score", (-F.col("target")).alias("t"), "gain")).alias("x"), *more)
    return best.select("id", "source", (-F.col("x.t")).alias("target"), "x.gain", "x.score", *best.columns[3:])


def best_moves(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(id, source, target, gain) of nodes whose best move makes the cut smaller; the smaller part on ties."""
    conn = connectivity(edges, part)
    own = part.select("id", F.col("p").alias("source"))
    here = conn.join(own, "id").where("p = source").select("id", F.col("w").alias("here"))
    there = conn.join(own, "id").where("p <> source").join(here, "id", "left")
    gain = F.col("w") - F.coalesce("here", F.lit(0.0))
    best = there.groupBy("id", "source").agg(F.max(F.struct(gain.alias("gain"), (-F.col("p")).alias("target"))).alias("x"))
    return best.where("x.gain > 0").select("id", "source", (-F.col("x.target")).alias("target"), F.col("x.gain").alias("gain"))


def project(labels: DataFrame, part: DataFrame) -> DataFrame:
    """A coarse partition on the finer nodes; part 0 where it has none."""
    return labels.join(part.withColumnRenamed("id", "coarse"), "coarse", "left").select("id", F.coalesce("p", F.lit(0)).cast("long").alias("p"))


def node_order(part: DataFrame) -> DataFrame:
    """(old, new): nodes by part, then id.  Ranges of (part, id) are numbered side by side, so that a large part is not one task's."""
    return ranked(part.select("p", F.col("id").alias("old")), ["p", "old"], "new").select("old", "new")


def expand(order: DataFrame, d: int) -> DataFrame:
    """Node order to row order: d rows for each node."""
    r = order.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    return r.select((F.col("old") * d + F.col("r")).cast("long").alias("old"), (F.col("new") * d + F.col("r")).cast("long").alias("new"))


def permuted_labels(part: DataFrame, order: DataFrame, d: int) -> DataFrame:
    """(row, p): the part of each row in the new order (old, new) of nodes, d rows to a node."""
    moved = part.join(order.withColumnRenamed("old", "id"), "id").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(d - 1))))
    return moved.select((F.col("new") * d + F.col("r")).cast("long").alias("row"), "p")


def permute(entries: DataFrame, order: DataFrame) -> DataFrame:
    a, b = order.select(F.col("old").alias("i"), F.col("new").alias("ni")), order.select(F.col("old").alias("j"), F.col("new").alias("nj"))
    return entries.join(a, "i").join(b, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def coverage(part: DataFrame, n: int) -> DataFrame:
    """(id, problem): nodes of 0..n-1 without a part, and parts of other nodes."""
    want = part.sparkSession.range(n)
    missing = want.join(part, "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    extra = part.select("id").join(want, "id", "left_anti").select("id", F.lit("extra").alias("problem"))
    return missing.unionAll(extra)


def bisection_energy(edges: DataFrame, nodes: DataFrame, side: DataFrame, balance: float = 1.0, target: float = 0.5) -> DataFrame:
    """Energy of a bisection (id, x) under the quadratic model, from sums alone.

    The model has a term for every pair of nodes; summed over a bisection they
    come to the cut share and the square of side 1's weight share.
    """
    share = nodes.join(side, "id").agg((F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("m"))
    cut = with_parts(edges, side.select("id", F.col("x").alias("p"))).agg((F.sum(F.when(F.col("pu") != F.col("pv"), F.col("w")).otherwise(0.0)) / F.sum(F.abs("w"))).alias("cut"))
    return share.join(cut).select((F.col("cut") + balance * (F.col("m") * F.col("m") - 2 * target * F.col("m"))).alias("energy"))  # one row each


def ising_fields(edges: DataFrame, nodes: DataFrame, balance: float = 1.0, target: float = 0.5) -> DataFrame:
    """(id, h) of the model in spins: -q_ii / 2 - sum of q_ij / 4, the sum in closed form."""
    scale, total = edges.agg(F.sum(F.abs("w")).alias("scale")), nodes.agg(F.sum("c").alias("total"))
    n = nodes.join(weighted_degrees(edges), "id", "left").join(F.broadcast(scale)).join(F.broadcast(total))  # one row each
    c, deg = F.col("c") / F.col("total"), F.coalesce("deg", F.lit(0.0)) / F.col("scale")
    own = deg + balance * c * (c - 2 * target)
    others = 2 * balance * c * (1 - c) - 2 * deg
    h = F.round(-own / 2 - others / 4, 9)
    return n.select("id", F.when(h == 0, 0.0).otherwise(h).alias("h"))


def bisection_energies(edges: DataFrame, nodes: DataFrame, sides: DataFrame, balance: float = 1.0, target: float = 0.5) -> DataFrame:
    """(sample, energy) of many bisections (sample, id, x) under the quadratic model."""
    n, scale = _shares(edges, nodes)
    share = sides.join(n, "id").groupBy("sample").agg(F.sum(F.col("share") * F.col("x")).alias("m"))
    a, b = sides.select("sample", F.col("id").alias("u"), F.col("x").alias("xu")), sides.select("sample", F.col("id").alias("v"), F.col("x").alias("xv"))
    cut = edges.join(a, "u").join(b, ["sample", "v"]).groupBy("sample").agg(F.sum(F.when(F.col("xu") != F.col("xv"), F.col("w")).otherwise(0.0)).alias("cut"))
    x = share.join(cut, "sample", "left").join(F.broadcast(scale))  # one row
    return x.select("sample", (F.coalesce("cut", F.lit(0.0)) / F.col("scale") + balance * (F.col("m") * F.col("m") - 2 * target * F.col("m"))).alias("energy"))


def independent(edges: DataFrame, moves: DataFrame, clashes: bool = False) -> DataFrame:
    """Moves that beat those of all their neighbours by (score, id), so that their gains add up.

    With ``clashes`` they need only beat neighbours with which they clash: one
    goes where the other leaves.  An edge between other moves ends no worse
    than both gains have it, so the cut falls by the sum of the gains at least.
    """
    near = symmetric(edges)
    for end in ("u", "v"):
        near = near.join(moves.select(F.col("id").alias(end), F.col("score").alias(f"g{end}"), F.col("source").alias(f"s{end}"), F.col("target").alias(f"t{end}")), end)
    if clashes:
        near = near.where("tu = sv OR tv = su")
    beaten = near.where("gv > gu OR (gv = gu AND v > u)").select(F.col("u").alias("id")).distinct()
    return moves.join(beaten, "id", "left_anti")


def independent_moves(edges: DataFrame, part: DataFrame) -> DataFrame:
    """Best moves by cut that do not touch each other."""
    return independent(edges, best_moves(edges, part).withColumn("score", F.col("gain"))).drop("score")


FEW = 1 << 20  # moves that one task may sort


def _running(moves: DataFrame, by: str, name: str, few: bool) -> DataFrame:
    """Moves with the weight of their part's moves up to them, best first.

    Where they are not few, all moves are ranked together, so that a part is
    not one task's.
    """
    if few:
        order = Window.partitionBy(by).orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
        return moves.withColumn(name, F.sum("c").over(order))
    placed = ranked(moves.withColumn("worst", -F.col("score")), [by, "worst", "id"], "before", F.col("c"), "double")
    first = placed.groupBy(by).agg(F.min("before").alias("first"))  # a row for each part
    return placed.join(F.broadcast(first), by).withColumn(name, F.col("before") - F.col("first") + F.col("c")).drop("worst", "before", "first")


def admitted_moves(edges: DataFrame, nodes: DataFrame, part: DataFrame, k: int, tolerance: float, objective: str = "cut", balance: float = 0.0, most: int | None = None, only: DataFrame | None = None, clashes: bool = False) -> DataFrame:
    """Independent moves, best first, while what leaves a part and what enters one keep to the bounds.

    Under ``cut_balance`` penalties do not add up, so one move at most leaves
    and enters each part.  Of ``most`` moves the best are taken.  Running sums
    count a part's movers alone.  ``only`` (id) names nodes that may move,
    no two of which are neighbours.
    """
    b = limits(nodes, part, k, tolerance)
    scores = _moves(edges, nodes, part, b, objective, balance, only)
    moves = materialise(best_by_score(scores, F.max("c").alias("c")))
    few = moves.count() <= FEW
    if only is None:
        moves = independent(edges, moves, clashes)
    if not few:
        moves = materialise(moves)
        few = moves.count() <= FEW
    if objective == "cut_balance":
        best = F.struct("score", (-F.col("id")).alias("i"))
        top = lambda x, p: x.groupBy(p).agg(F.max_by(F.struct(*moves.columns), best).alias("m")).select("m.*")
        # A part whose best move out is another part's second best in waits for the next pass.
        out = materialise(top(top(moves, "source"), "target"))
        # A part that both gives and takes has two changes: only the better one stands.
        ends = out.select("id", "score", F.explode(F.array("source", "target")).alias("p"))
        wins = ends.groupBy("p").agg(F.max_by("id", best).alias("wins"))
        lost = ends.join(wins, "p").where("id <> wins").select("id").distinct()
        out = out.join(lost, "id", "left_anti")
    else:
        out = _running(_running(moves, "source", "leaves", few), "target", "enters", few)
        of = lambda c, end: F.get(b[c], F.col(end))
        out = out.where((F.col("leaves") <= of("weight", "source") - of("lower", "source")) & (F.col("enters") <= of("upper", "target") - of("weight", "target")))
    if most is not None:
        out = out.orderBy(F.desc("score"), "id").limit(most)
    return out.select("id", "source", "target", "gain", "score")


def moved(part: DataFrame, moves: DataFrame) -> DataFrame:
    return part.join(moves.select("id", "target"), "id", "left").select("id", F.coalesce("target", "p").cast("long").alias("p"))


REFINED = 1 << 22  # edges that one task may refine
LAYERS = 8  # passes that surroundings of the boundary serve


def _surroundings(edges: DataFrame, part: DataFrame, passes: int, few: int) -> tuple[DataFrame | None, int]:
    """The edges that up to ``passes`` passes look at, and how many passes these serve; none where more than ``few`` touch the boundary.

    A node can move in a pass only if it has a neighbour in another part, so the
    first pass moves nodes of the boundary, each further one nodes one step
    further away at most.
    """
    near, served = None, 0
    reach = boundary(edges, part)
    while served < passes:
        reach = materialise(reach)
        if reach.count() > few:
            break
        u, v = (reach.select(F.col("id").alias(end), F.lit(True).alias(f"near_{end}")) for end in ("u", "v"))
        found = materialise(edges.join(u, "u", "left").join(v, "v", "left").where("near_u OR near_v").select("u", "v", "w"))
        if found.count() > few:
            break
        near, served = found, served + 1
        reach = found.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return near, served


def _passes(edges: DataFrame, nodes: DataFrame, part: DataFrame, k: int, tolerance: float, passes: int, most: int | None, clashes: bool) -> DataFrame:
    """(id, target) of nodes that passes of ``refine`` move along few edges, by one task; the row without an id tells how many passes moved any.

    A pass is that of ``admitted_moves``: connections are summed anew for the
    neighbours of what has moved alone.
    """
    told = _limits(nodes, part, k, tolerance)
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    weights = nodes.select("id", guards.node_weight(F.col("c")).alias("w"), guards.balance_weight(F.col("c")).alias("weight"))
    own = part.join(ends, "id", "left_semi").join(weights, "id", "left")
    inside = F.when(F.col("p").between(0, k - 1), F.col("p")).otherwise(k).cast("long")
    rows = own.select(F.col("id").alias("u"), inside.alias("v"), "w", "weight", F.lit(True).alias("node"))
    rows = rows.unionAll(edges.select("u", "v", "w", F.lit(0.0).alias("weight"), F.lit(False).alias("node")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [[x.to_numpy() for x in (*(b.loc[b["node"], c] for c in ("u", "v", "w", "weight")), *(b.loc[~b["node"], c] for c in ("u", "v", "w")))] for b in batches]
        if not found:
            return
        ids, p, c, weighs, a, b, w = map(np.concatenate, zip(*found, strict=True))
        del found
        order = np.argsort(ids)
        ids, p, c, weighs = ids[order], p[order], c[order], weighs[order]
        n, known = len(ids), np.isin(a, ids) & np.isin(b, ids)
        a, b, w = np.searchsorted(ids, a[known]), np.searchsorted(ids, b[known]), np.concatenate([w[known]] * 2)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(a * n + b)  # sums are the same whatever the partitions
        a, b, w = a[order], b[order], w[order]
        weight, lower, upper = (np.array(told[x]) for x in ("weight", "lower", "upper"))
        start, at, movable = p.copy(), np.arange(n), (p < k) & ~np.isnan(c)
        conn, met = np.zeros((n, k + 1)), np.zeros((n, k + 1), bool)
        look, some = np.ones(n, bool), 0
        while some < passes:
            i, rank = np.flatnonzero(look[a]), np.cumsum(look) - 1
            to, size = rank[a[i]] * (k + 1) + p[b[i]], int(look.sum()) * (k + 1)
            conn[look] = np.bincount(to, w[i], size).reshape(-1, k + 1)
            met[look] = np.bincount(to, minlength=size).reshape(-1, k + 1) > 0
            gain = conn[:, :k] - conn[at, p][:, None]
            q = np.minimum(p, k - 1)
            ok = met[:, :k] & (gain > 0) & (movable & (weight[q] - c >= lower[q]))[:, None] & (weight + c[:, None] <= upper)
            ok[at, q] = False
            gain[~ok] = -np.inf
            target = np.argmax(gain, axis=1)  # the smaller part on ties
            best, moves = gain[at, target], ok.any(axis=1)
            i = np.flatnonzero(moves[a] & moves[b])
            x, y = a[i], b[i]
            beaten = (best[y] > best[x]) | ((best[y] == best[x]) & (y > x))
            if clashes:
                beaten &= (target[x] == p[y]) | (target[y] == p[x])
            moves[x[beaten]] = False
            m = np.flatnonzero(moves)
            m = m[np.lexsort((m, -best[m]))]
            leaves, enters = np.zeros(len(m)), np.zeros(len(m))
            for part_ in range(k):
                for ends_, sums in ((p[m] == part_, leaves), (target[m] == part_, enters)):
                    sums[ends_] = np.cumsum(c[m[ends_]])
            m = m[(leaves <= (weight - lower)[p[m]]) & (enters <= (upper - weight)[target[m]])][:most]
            if not len(m):
                break
            np.subtract.at(weight, p[m], weighs[m])
            np.add.at(weight, target[m], weighs[m])
            p[m] = target[m]
            went = np.zeros(n, bool)
            went[m] = True
            look = np.zeros(n, bool)
            look[b[went[a]]] = True
            some += 1
        i = np.flatnonzero(p != start)
        yield pd.DataFrame({"id": pd.array(ids[i], "Int64"), "target": p[i]})
        yield pd.DataFrame({"id": pd.array([None], "Int64"), "target": [some]})

    return rows.repartition(1).mapInPandas(run, "id long, target long")


def refine(edges: DataFrame, nodes: DataFrame, part: DataFrame, k: int, tolerance: float, passes: int = 10, objective: str = "cut", balance: float = 0.0, most: int | None = None, clashes: bool = False, few: int = REFINED) -> DataFrame:
    """The partition after passes of admitted moves, until there is none; the cut never grows under ``cut`` and bounds hold once they do.

    One part or none is one part of all.  ``clashes`` is that of ``independent``:
    more moves in a pass, and fewer passes.  Under ``cut`` one task goes through
    the passes of a graph of ``few`` edges at most, or through some passes at
    the boundary where no more edges are near it; other passes are joins.
    """
    if k <= 1:
        return nodes.select("id", F.lit(0).cast("long").alias("p"))
    edges, done, tried = edges.select("u", "v", guards.edge_weight(F.col("w")).alias("w")), 0, 0
    whole = objective == "cut" and edges.count() <= few
    while done < passes:
        near, served = edges, passes
        if not whole:
            near, served = None, 0
            if objective == "cut" and few and done >= tried:
                near, served = _surroundings(edges, part, min(passes - done, LAYERS), few)
                tried = done + 5  # where too much is near the boundary, it is looked at again after some passes
        if served:
            tried = 0
            moves = materialise(_passes(near, nodes, part, k, tolerance, served, most, clashes))
        else:
            moves = admitted_moves(edges, nodes, part, k, tolerance, objective, balance, most, clashes=clashes).select("id", "target")
        after = part.select("id", "p").join(moves, "id", "left")
        after = materialise(after.select("id", F.coalesce("target", "p").cast("long").alias("p"), F.col("target").isNotNull().alias("moved")))  # moves and their outcome in one job
        if after.where("moved").isEmpty():
            break
        part, done = after.select("id", "p"), done + max(served, 1)
        if served and moves.where("id IS NULL").first()["target"] < served:
            break
    return part


#: The order in which colours are given, a scattering of ids.
PRIORITY = "(id * 7919 + 104729) % 1000003"


def colours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, colour) of the given nodes: no edge joins two of one colour.

    Jones and Plassmann's rounds: those that come before all their uncoloured
    neighbours, by PRIORITY and id, take the round's number together.
    """
    key = F.struct(F.expr(PRIORITY).alias("p"), "id")
    left = ids.select("id", key.alias("key"))
    near = symmetric(edges).join(left.select(F.col("id").alias("u"), F.col("key").alias("ku")), "u").join(left.select(F.col("id").alias("v"), F.col("key").alias("kv")), "v")
    near = materialise(near.where("kv > ku").select("u", "v"))  # a node waits for these
    left, done, n = materialise(ids.select("id")), [], 0
    while not left.isEmpty():
        waits = near.join(left.withColumnRenamed("id", "v"), "v", "left_semi").select(F.col("u").alias("id")).distinct()
        new = materialise(left.join(waits.withColumn("waits", F.lit(True)), "id", "left").select("id", F.coalesce("waits", F.lit(False)).alias("waits")))
        done.append(new.where("not waits").select("id", F.lit(n).cast("long").alias("colour")))
        left, n = new.where("waits").select("id"), n + 1
    return reduce(DataFrame.unionAll, done) if done else ids.select("id", F.lit(0).cast("long").alias("colour"))


def refine_by_colours(edges: DataFrame, nodes: DataFrame, part: DataFrame, k: int, tolerance: float, passes: int = 10, objective: str = "cut", balance: float = 0.0, most: int | None = None) -> DataFrame:
    """As ``refine``, with updates inside a pass: the boundary's colours move one after another, each with gains and weights as the last one left them.

    Nodes of one colour are no neighbours, so their gains add up.
    """
    if k <= 1:
        return nodes.select("id", F.lit(0).cast("long").alias("p"))
    edges = edges.select("u", "v", guards.edge_weight(F.col("w")).alias("w"))
    for _ in range(passes):
        classes = materialise(colours(edges, boundary(edges, part)))
        last, moved_any, n = classes.agg(F.max("colour")).first()[0], False, 0
        for colour in range(-1 if last is None else last, -1, -1):
            moves = materialise(admitted_moves(edges, nodes, part, k, tolerance, objective, balance, None if most is None else most - n, classes.where(F.col("colour") == colour)))
            some = moves.count()
            if some:
                part, moved_any, n = materialise(moved(part, moves)), True, n + some
            if most is not None and n >= most:
                break
        if not moved_any:
            break
    return part
