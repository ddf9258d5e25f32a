"""The whole run and its parts: invariants, hand-checked cases, rules."""

import itertools
import random

import numpy as np
import pytest

from graphband import config
from graphband.operators import components, graph, kway, metrics, partition, spectral
from graphband.plans import multilevel
from graphband.session import materialise
from graphband.sources import artifacts, lattice, mtx


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def triangles(spark):
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0), (3, 4, 3.0), (4, 5, 2.0), (3, 5, 1.0), (2, 3, 1.0)], "u long, v long, w double")
    return materialise(edges), materialise(spark.range(6).selectExpr("id", "1.0D AS c"))


def test_levels_and_level_sets(triangles):
    start = triangles[1].where("id = 0")
    assert rows(components.levels(triangles[0], start)) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    parts = dict(rows(kway.level_sets(*triangles, 2)))
    assert {frozenset(i for i in parts if parts[i] == p) for p in (0, 1)} == {frozenset((0, 1, 2)), frozenset((3, 4, 5))}


def test_levels_of_separate_components(spark, triangles):
    edges = triangles[0].where("u <> 2 OR v <> 3")
    assert rows(components.graph_components(edges, triangles[1])) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]
    assert rows(components.levels(edges, triangles[1].where("id IN (1, 4)"))) == [(0, 1), (1, 0), (2, 1), (3, 1), (4, 0), (5, 1)]


def test_long_levels_and_components(spark):
    """A path longer than a job's steps, a ring and isolated nodes, against a plain search."""
    pairs = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    edges = spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "u long, v long, w double")
    found = dict(rows(components.levels(edges, spark.createDataFrame([(3,), (104,)], "id long"))))
    assert found == {i: abs(i - 3) for i in range(41)} | {100 + i: min((i - 4) % 9, (4 - i) % 9) for i in range(9)}
    nodes = spark.range(200).selectExpr("id", "1.0D AS c")
    assert dict(rows(components.graph_components(edges, nodes))) == {i: 0 if i <= 40 else 100 if 100 <= i < 109 else i for i in range(200)}


def _jobs(spark, run):
    """What a call returns, and how many jobs it starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return out, len(tracker.getJobIdsForGroup(group))


def test_isolated_nodes_cost_no_jobs(spark):
    edges = spark.createDataFrame([(3, 9, 1.0)], "u long, v long, w double")
    count = {}
    for n in (12, 10_000):
        nodes = materialise(spark.range(n).selectExpr("id", "1.0D AS c"))
        parts, count[n] = _jobs(spark, lambda nodes=nodes: kway.partition("levels", edges, nodes, 4).groupBy("p").count().collect())
        assert sorted(r["count"] for r in parts) == [n // 4] * 4
    assert count[10_000] <= count[12] + 4


def test_fiedler_against_a_dense_solver(spark):
    """Eigenvalue, residual and numbers of a weighted graph of two components, by numpy."""
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(30), 2))): rng.randint(1, 9) for _ in range(70)}
    pairs |= {(i, i + 1): 1 for i in range(29)} | {(50, 51): 2, (51, 52): 3, (50, 53): 4}
    edges = materialise(spark.createDataFrame([(u, v, float(w)) for (u, v), w in pairs.items()], "u long, v long, w double"))
    nodes = spark.range(60).selectExpr("id", "1.0D AS c")
    y, told = spectral.fiedler(edges, components.graph_components(edges, nodes), rounds=40, residual=1e-7)
    got, theta = {r["id"]: r["y"] for r in y.collect()}, {r["comp"]: r["theta"] for r in told.collect()}
    for comp, ids in ((0, range(30)), (50, range(50, 54))):
        ids = list(ids)
        w = np.array([[pairs.get((min(a, b), max(a, b)), 0) for b in ids] for a in ids], float)
        d = np.sqrt(w.sum(axis=1))
        values, vectors = np.linalg.eigh(w / np.outer(d, d))
        assert theta[comp] == pytest.approx(values[-2], abs=1e-9)
        own, want = np.array([got[i] for i in ids]), vectors[:, -2] / d
        assert abs(own @ want) / np.linalg.norm(own) / np.linalg.norm(want) == pytest.approx(1, abs=1e-6)


def test_fiedler_in_tasks_and_in_joins(spark):
    """Components in one task each and in joins give the same numbers; few edges cost no job a round, and rounds are few."""
    rng = random.Random(8)
    pairs = {tuple(sorted((c * 100 + a, c * 100 + b))): float(rng.randint(1, 9)) for c in range(2) for a, b in (rng.sample(range(60), 2) for _ in range(150))}
    pairs |= {(c * 100 + i, c * 100 + i + 1): 1.0 for c in range(2) for i in range(59)}
    edges = materialise(spark.createDataFrame([(u, v, w) for (u, v), w in pairs.items()], "u long, v long, w double"))
    nodes = materialise(spark.sql("SELECT explode(sequence(0L, 159L)) AS id").where("id % 100 < 60"))
    comps = materialise(components.graph_components(edges, nodes))
    got, jobs = {}, {}
    for few in (0, 1 << 18):
        made, one = [], spectral.materialise
        spectral.materialise = lambda x: made.append(1) or one(x)  # noqa: B023
        try:
            y, told = spectral.fiedler(edges, comps, rounds=40, residual=1e-6, few=few)
        finally:
            spectral.materialise = one
        got[few], jobs[few] = {r["id"]: r["y"] for r in y.collect()}, len(made)
        assert len(got[few]) == 120 and told.count() == 2 and told.where("residual > 1e-6").isEmpty()
    assert jobs[1 << 18] <= 6 < jobs[0] <= 6 + 3 * 12  # tables written: three a round in joins
    for c in (0, 1):
        a, b = (np.array([got[few][c * 100 + i] for i in range(60)]) for few in got)
        assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) == pytest.approx(1, abs=1e-6)


def test_searches_in_tasks_and_in_joins(spark):
    """Levels from the rim are the same by joins, by tasks and by both; nodes without an edge are levels of their own."""
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)} | {(50 + i, 51 + i) for i in range(20)}
    edges = materialise(spark.createDataFrame([(u, v, 1.0) for u, v in pairs], "u long, v long, w double"))
    nodes = spark.range(80).selectExpr("id", "1.0D AS c")
    blocks = nodes.selectExpr("id", "CASE WHEN id < 40 THEN id % 2 ELSE 0 END AS p")
    jobs, got = {}, {}
    for few in (0, 15, 1 << 18):
        found, jobs[few] = _jobs(spark, lambda few=few: rows(kway._rim(edges, nodes, blocks, 1, few)))
        got[few] = found
    assert got[0] == got[15] == got[1 << 18] and len(got[0]) == 80
    assert jobs[1 << 18] < jobs[0]


def test_spectral_cuts_no_worse_than_levels(spark):
    pairs = materialise(lattice.couplings(spark, 12, 4, 3))
    k = materialise(lattice.matrix(pairs, 1, "k"))
    edges, nodes = materialise(graph.matrix_to_graph(k, 1)), materialise(graph.node_weights(k, 144, 1))
    cut = lambda name: partition.edge_cut(edges, materialise(kway.partition(name, edges, nodes, 2))).first()[0]
    assert cut("spectral") <= cut("levels") * (1 + 1e-9)


@pytest.mark.parametrize("k", [2, 4, 8])
def test_depths_give_the_blocks_of_one_split_after_another(spark, k):
    pairs = materialise(lattice.couplings(spark, 8, 3, 2))
    m = materialise(lattice.matrix(pairs, 1, "k"))
    edges, nodes = materialise(graph.matrix_to_graph(m, 1)), materialise(spark.range(48).selectExpr("id", "1.0D AS c"))
    blocks = lambda part: {frozenset(i for i, q in part if q == p) for p in {q for _, q in part}}
    by_id = lambda e, n, b, seed: n.selectExpr("id", "0L AS comp", "(id * 37 % 48) * 1.0D AS key")
    one = kway.recursive(edges, nodes, k, bisect=kway.bisect_by(by_id))
    found = kway.by_depth(edges, nodes, k, orders=by_id)
    assert blocks(rows(found.select("id", "p"))) == blocks(rows(one)) and len(blocks(rows(one))) == k


def test_starts_together(spark, triangles):
    """Each start is a partition of its own, and the best one is that of a loop over their scores."""
    parts = materialise(kway.by_depth(*triangles, 2, 0.3, 1, starts=3))
    assert sorted(r["count"] for r in parts.groupBy("start").count().collect()) == [6, 6, 6]
    scores = dict(rows(kway.start_scores(*triangles, parts, 2, 0.1)))
    for i in range(3):
        own = materialise(parts.where(f"start = {i}").select("id", "p"))
        assert scores[i] == pytest.approx(partition.partition_score(*triangles, own, 2, 0.1, 1.0).first()["score"])
    best = min(scores, key=lambda i: (scores[i], i))
    assert rows(kway.several_starts(*triangles, 2, 0.3, 1)) == rows(kway.by_depth(*triangles, 2, 0.3, 1, starts=3).where(f"start = {best}").select("id", "p"))


def one_visit_after_another(pairs, weight, order, cap):
    """The plain greedy pass."""
    near = {}
    for (u, v), w in pairs.items():
        near.setdefault(u, {})[v] = w
        near.setdefault(v, {})[u] = w
    mate = {}
    for u in order:
        if u in mate:
            continue
        free = [v for v in near.get(u, {}) if v not in mate and (cap is None or weight[u] + weight[v] <= cap)]
        key = lambda v: (round(near[u][v], 9), near[u][v], (min(u, v) * 31 + max(u, v) * 17) % 1009, min(u, v), max(u, v))  # noqa: B023, E731
        v = max(free, key=key, default=u)
        mate[u], mate[v] = v, u
    return mate


def test_rounds_of_matching_are_few_and_match_one_task(spark):
    """Rounds alone, rounds ended by one task, and one task alone match alike; a sorted order takes few rounds."""
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(200), 2))): float(rng.randint(1, 5)) for _ in range(2000)}
    edges = materialise(spark.createDataFrame([(u, v, w) for (u, v), w in pairs.items()], "u long, v long, w double"))
    nodes = materialise(spark.range(203).selectExpr("id", "1.0D + id % 3 AS c"))
    order = [r["id"] for r in graph.visit_order(edges, nodes, "sorted").orderBy("place").collect()]
    want = one_visit_after_another(pairs, {i: 1.0 + i % 3 for i in range(203)}, order, None)
    rounds = []
    for few in (0, 1000, 1 << 18):
        made, one = [], graph.materialise
        graph.materialise = lambda x: made.append(1) or one(x)  # noqa: B023
        try:
            assert dict(rows(graph.visit_matching(edges, nodes, "sorted", few=few))) == want
        finally:
            graph.materialise = one
        rounds.append(len(made))
    assert rounds[2] < rounds[1] < rounds[0] <= 45  # tables written
    assert len({tuple(rows(graph.matching(edges, nodes, cap=5.0, few=few))) for few in (0, 1000, 1 << 18)}) == 1


@pytest.mark.parametrize(("strategy", "cap"), [("sorted", None), ("random", None), ("random", 5.0)])
def test_matching_in_visit_order(spark, strategy, cap):
    rng = random.Random(11)
    pairs = {tuple(sorted(rng.sample(range(80), 2))): float(rng.randint(1, 4)) for _ in range(240)}
    weight = {i: float(rng.randint(1, 4)) for i in range(90)}
    edges = materialise(spark.createDataFrame([(u, v, w) for (u, v), w in pairs.items()], "u long, v long, w double"))
    nodes = materialise(spark.createDataFrame(list(weight.items()), "id long, c double"))
    order = [r["id"] for r in graph.visit_order(edges, nodes, strategy, 3).orderBy("place").collect()]
    found = dict(rows(graph.visit_matching(edges, nodes, strategy, cap, 3)))
    assert found == one_visit_after_another(pairs, weight, order, cap)
    assert any(u != v for u, v in found.items())
    done = graph.chain(edges, nodes, 20, None, strategy, cap, rule="visit", max_levels=2)
    assert done.levels[1]["nodes"] == len({min(x) for x in dict(rows(graph.visit_matching(edges, nodes, strategy, cap, 0))).items()})


def test_colours_and_refinement_by_colours(spark):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(200)})
    edges = materialise(spark.createDataFrame([(u, v, float(rng.randint(1, 9))) for u, v in pairs], "u long, v long, w double"))
    nodes = materialise(spark.range(60).selectExpr("id", "1.0D AS c"))
    colour = dict(rows(partition.colours(edges, nodes)))
    assert all(colour[u] != colour[v] for u, v in pairs) and set(colour) == set(range(60))
    part = materialise(nodes.selectExpr("id", "id % 3 AS p"))
    cut = lambda p: partition.edge_cut(edges, p).first()["cut"]
    after = partition.refine_by_colours(edges, nodes, part, 3, 0.2, passes=1)
    assert cut(after) < cut(part) and cut(after) <= cut(partition.refine(edges, nodes, part, 3, 0.2, passes=1))
    weights = partition.part_weights(nodes, after, 3).collect()
    assert all(16 <= r["weight"] <= 24 for r in weights)


def test_recursive_bisection(triangles):
    parts = dict(rows(kway.partition("recursive", *triangles, 2)))
    assert parts[0] == parts[1] == parts[2] != parts[3] == parts[4] == parts[5]
    assert {p for _, p in rows(kway.partition("recursive", *triangles, 3))} == {0, 1, 2}
    with pytest.raises(ValueError):
        kway.partition("other", *triangles, 2)
    assert {p for _, p in rows(kway.partition("levels", *triangles, 1))} == {0}


def test_empty_side_is_halved(triangles):
    one_side = lambda e, n, t, s: n.selectExpr("id", "0 AS x")
    assert rows(kway.recursive(*triangles, 2, bisect=one_side)) == [(i, int(i > 2)) for i in range(6)]


def test_clamp_and_targets():
    assert [kway.clamp(k, 3) for k in (0, 2, 9)] == [1, 2, 3]
    with pytest.raises(ValueError):
        kway.clamp(2, 0)
    assert kway.split_target(0.0, 0.1, 0.3) == 0 and kway.split_target(10.0, 0, 0.9) == 5
    assert kway.split_target(10.0, 10, 0.0) == 4 and kway.split_target(10.0, 1.0, 0.999) == 9


def test_cut_balance_moves_keep_bounds_and_lower_the_objective(spark):
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(160)})
    edges = materialise(spark.createDataFrame([(u, v, float(rng.randint(1, 9))) for u, v in pairs], "u long, v long, w double"))
    nodes = materialise(spark.createDataFrame([(i, float(rng.randint(1, 5))) for i in range(40)], "id long, c double"))
    part = materialise(spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, p long"))
    weight, link, before = dict(rows(nodes)), rows(edges), dict(rows(part))
    share = sum(weight.values()) / 4

    def objective(p, lam):
        w = [sum(weight[i] for i in p if p[i] == k) for k in range(4)]
        return sum(x for u, v, x in link if p[u] != p[v]) + lam * sum((x - share) ** 2 for x in w), w

    for name, lam in (("cut", 0.0), ("cut_balance", 0.05)):
        after = dict(rows(partition.refine(edges, nodes, part, 4, 0.5, 2, name, lam)))
        assert objective(after, lam)[0] < objective(before, lam)[0]
        assert all(0.5 * share <= x <= 1.5 * share for x in objective(after, lam)[1])
    few = partition.refine(edges, nodes, part, 4, 0.5, 1, "cut", 0.0, most=2)
    assert sum(before[i] != p for i, p in rows(few)) == 2
    assert {p for _, p in rows(partition.refine(edges, nodes, part, 1, 0.5))} == {0}


def test_move_scores_against_definition(triangles, spark):
    edges, nodes = triangles
    part = spark.createDataFrame([(i, int(i > 1)) for i in range(6)], "id long, p long")
    got = {(i, t): (g, round(s, 9)) for i, _, t, g, s in rows(partition.move_scores(edges, nodes, part, 2, 0.9, "cut_balance", 0.1))}
    # parts weigh 2 and 4 of an even 3: node 2 leaves for part 0, which levels them: (3-3)^2 + (3-3)^2 - 1 - 1 = -2
    assert got == {(2, 0): (2.0, 2.2)}


def test_quadratic_model_is_the_cut_and_the_balance(triangles):
    edges, nodes = triangles
    linear = dict(rows(partition.qubo_linear(edges, nodes)))
    pairs = {(u, v): q for u, v, q in rows(partition.qubo_quadratic(edges, nodes))}
    spins = {(u, v): j for u, v, j in rows(partition.ising_couplings(edges, nodes))}
    assert all(spins[k] == pytest.approx(q / 4, abs=1e-8) for k, q in pairs.items())
    best = []
    for x in itertools.product((0, 1), repeat=6):
        e = sum(linear[i] * x[i] for i in range(6))
        e += sum(pairs.get((i, j), 2 / 36) * x[i] * x[j] for i, j in itertools.combinations(range(6), 2))
        best.append((round(e, 6), x))
    assert min(best) == (-0.173077, (0, 0, 0, 1, 1, 1))


@pytest.mark.parametrize(
    ("inferior", "superior", "most", "reason", "levels", "reachable"),
    [(1, 6, 30, "the first graph is in range", 1, True), (3, 4, 30, "level 1 is in range", 2, True), (5, None, 30, "level 1 would fall below the least size (4 < 5)", 1, True), (1, 2, 1, "6 nodes after 1 levels", 1, False), (4, None, 30, "4 nodes reached", 2, True)],
)
def test_stop_rules(triangles, inferior, superior, most, reason, levels, reachable):
    out = graph.chain(*triangles, inferior, superior, "sorted", max_levels=most)
    assert (out.reason, len(out.graphs), out.reachable) == (reason, levels, reachable)
    if superior and not reachable:
        with pytest.raises(ValueError):
            graph.coarsen(*triangles, inferior, superior, "sorted", max_levels=most)


def test_stop_rules_of_shrinking(triangles):
    assert graph.chain(*triangles, 1, None, "sorted", ratio=0.5).reason == "level 1 shrinks to 0.667 only"
    assert graph.chain(*triangles, 1, None, "sorted", cap=1.0).reason == "level 1 does not shrink"
    for wrong in ((0, None), (3, 2)):
        with pytest.raises(ValueError):
            graph.chain(*triangles, *wrong)


@pytest.fixture(scope="module")
def run(spark):
    pairs = materialise(lattice.couplings(spark, 4, 3, 2))
    matrices = {k.upper(): materialise(lattice.matrix(pairs, 2, k)) for k in "km"}
    return matrices, multilevel.run(matrices, 48, multilevel.Settings(dof=2, inferior=5, superior=14, k=2, tolerance=0.3, passes=2))


def test_run_keeps_what_it_must(run):
    matrices, done = run
    weights = [round(n.agg({"c": "sum"}).first()[0], 6) for _, n in done.chain.graphs]
    assert len(set(weights)) == 1 and len(done.chain.maps) == len(done.chain.graphs) - 1
    order = rows(done.order)
    assert sorted(a for a, _ in order) == sorted(b for _, b in order) == list(range(48))
    new = dict(order)
    for name, m in matrices.items():
        assert rows(done.permuted[name]) == sorted((new[i], new[j], v) for i, j, v in rows(m))
    assert {p for _, p in rows(done.part)} <= {0, 1} and len(rows(done.part)) == 24
    checks = {r["matrix"]: r["value"] for r in done.figures.where("variant = 'check' AND metric = 'mismatches'").collect()}
    assert checks == {"K": 0, "M": 0}
    assert metrics.warnings(done.figures.where("false")).count() == 0
    assert multilevel.summary(done).count() == 1


def test_run_refuses_wrong_shapes(run):
    matrices, _ = run
    with pytest.raises(ValueError):
        multilevel.run(matrices, 48, multilevel.Settings(dof=5))
    with pytest.raises(ValueError):
        multilevel.run(matrices, 48, multilevel.Settings(dof=2, inferior=1, superior=2, max_levels=1))


def test_artifacts(spark, run, tmp_path):
    _, done = run
    folder = str(tmp_path / "run")
    assert len(artifacts.save(done, folder, ("permutation", "run_metrics", "coarsened_graph"))) == 4
    found = artifacts.load(spark, folder)
    assert set(found) == {"partitions", "permutation", "run_metrics", "coarsened_graph"}
    assert sorted(int(r[0]) for r in found["permutation"].collect()) == list(range(48))
    assert rows(found["coarsened_graph"]) == rows(artifacts.coarse_graph(done))
    assert found["partitions"].where("stage = 'final'").count() == 24
    lines = artifacts.table_lines(done.figures, "K")
    assert lines[0].split() == ["metric", "original", "permuted"] and len(lines) == 107
    with pytest.raises(Exception):  # noqa: B017
        artifacts.save(done, folder)
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n" + "% c\n" * 1500 + "2 2 1\n1 2 5\n")
    assert [r["path"].rsplit("/", 1)[1] for r in artifacts.listing(spark, str(tmp_path)).collect()] == ["a.mtx"]
    assert rows(mtx.read(spark, str(tmp_path / "a.mtx"))) == [(0, 1, 5.0)]


def test_lattice_is_symmetric_and_dominant(run):
    entries = {(i, j): v for i, j, v in rows(run[0]["K"])}
    assert all(entries[j, i] == v for (i, j), v in entries.items())
    for i in range(48):
        assert entries[i, i] > sum(abs(v) for (a, b), v in entries.items() if a == i and b != i)


DOCUMENT = {
    "general_parameters": {"dof_per_node": "3", "seed": 42},
    "coarsening_parameters": {"coarsen_inferior_limit": 5, "coarsen_superior_limit": 9, "max_levels": 30.0, "strategy": " Modified", "coarsen_ratio": 0.99},
    "partitioning_parameters": {"partitioning_strategy": "levels", "strategies": {"other": {"x": 1}}},
    "uncoarsening_parameters": {"refine_objective": "CUT", "refine_balance_lambda": 0, "refine_max_passes_per_level": 2, "validate_node_weights": "yes"},
}


def test_parameters():
    out = config.parameters(DOCUMENT)
    assert out["general_parameters"]["dof_per_node"] == 3 and out["coarsening_parameters"]["strategy"] == "modified"
    assert out["partitioning_parameters"]["common"] == {"k_target": 2, "balance_tolerance": 0.1}
    assert out["partitioning_parameters"]["strategies"] == {"other": {"x": 1}} and out["uncoarsening_parameters"]["validate_node_weights"] is True
    assert config.validity(DOCUMENT) == (True, None)


@pytest.mark.parametrize(
    ("block", "name", "value"),
    [("general_parameters", "dof_per_node", 0), ("general_parameters", "seed", True), ("general_parameters", "seed", None), ("coarsening_parameters", "coarsen_superior_limit", 4), ("coarsening_parameters", "coarsen_ratio", 0), ("coarsening_parameters", "coarsen_ratio", float("nan")), ("coarsening_parameters", "strategy", "heavy"), ("partitioning_parameters", "partitioning_strategy", "Levels"), ("uncoarsening_parameters", "refine_max_moves_per_pass", 0), ("uncoarsening_parameters", "validate_node_weights", "maybe")],
)
def test_parameters_refused(block, name, value):
    wrong = {**DOCUMENT, block: {**DOCUMENT[block], name: value}}
    assert config.validity(wrong)[0] is False


def test_run_config():
    good = {"parameters_file_path": " a.json ", "input_matrices": {"matrix_k_file_path": "k.mtx ", "matrix_m_file_path": "m.mtx"}, "save_output": None}
    assert config.run_config(good)["parameters_file_path"] == "a.json" and config.run_config(good)["save_output"] == []
    for wrong in ({"plots": []}, {"save_output": ["plot_png"]}, {"parameters_file_path": "a.txt"}, {"input_matrices": {}}):
        with pytest.raises(ValueError):
            config.run_config({**good, **wrong})
    assert config.contained("/data", "a/../b.json") == "/data/b.json" and config.sanitised("a b/c") == "a_b_c"
    for path in ("../x.json", "/etc/x.json"):
        with pytest.raises(ValueError):
            config.contained("/data", path)
    assert config.merged({"s": {"a": 1, "b": 2}}, {"s": {"b": 3}}) == {"s": {"a": 1, "b": 3}}


def test_running_sums_of_many_moves(spark, monkeypatch):
    """Moves that are ranked over all parts are admitted as those that a window sums up."""
    rng = random.Random(12)
    pairs = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(300)})
    edges = materialise(spark.createDataFrame([(u, v, float(rng.randint(1, 9))) for u, v in pairs], "u long, v long, w double"))
    nodes = materialise(spark.createDataFrame([(i, float(rng.randint(1, 5))) for i in range(80)], "id long, c double"))
    part = materialise(nodes.selectExpr("id", "id % 3 AS p"))
    few = rows(partition.admitted_moves(edges, nodes, part, 3, 0.05))
    monkeypatch.setattr(partition, "FEW", 0)
    assert few and rows(partition.admitted_moves(edges, nodes, part, 3, 0.05)) == few


@pytest.mark.parametrize("k", [2, 4])
def test_moves_that_do_not_clash_add_up(spark, k):
    """The cut falls by the sum of the gains at least, pass after pass, with more moves than those that touch no other."""
    rng = random.Random(k)
    pairs = sorted({tuple(sorted(rng.sample(range(90), 2))) for _ in range(500)})
    edges = materialise(spark.createDataFrame([(u, v, float(rng.randint(1, 9))) for u, v in pairs], "u long, v long, w double"))
    nodes = materialise(spark.range(90).selectExpr("id", "1.0D AS c"))
    part = materialise(nodes.selectExpr("id", f"id * 7 % {k} AS p"))
    cut = lambda p: partition.edge_cut(edges, p).first()["cut"]
    for _ in range(3):
        moves = materialise(partition.admitted_moves(edges, nodes, part, k, 0.5, clashes=True))
        assert moves.count() >= partition.admitted_moves(edges, nodes, part, k, 0.5).count()
        after = materialise(partition.moved(part, moves))
        assert cut(after) <= cut(part) - (moves.agg({"gain": "sum"}).first()[0] or 0) + 1e-9
        part = after


def test_lattice_pairs_are_not_broadcast(spark):
    plan = lattice.couplings(spark, 4, 3, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell" in plan and "BroadcastHashJoin" not in plan


def test_a_refinement_pass_writes_two_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(partition, "materialise", lambda df: written.append(1) or materialise(df))
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0), (3, 4, 3.0), (4, 5, 2.0), (3, 5, 1.0), (2, 3, 1.0)], "u long, v long, w double")
    nodes = spark.createDataFrame([(i, 1.0) for i in range(6)], "id long, c double")
    part = nodes.selectExpr("id", "CASE WHEN id < 2 THEN 0L ELSE 1L END AS p")
    after = partition.refine(edges, nodes, part, 2, 0.5, passes=1)
    assert len(written) == 2 and {r["id"] for r in after.where("p = 0").collect()} == {0, 1, 2}


def test_components_in_a_task_and_in_rounds(spark):
    """One task joins few edges to what the rounds give, in fewer jobs; loops, null ends and repeated edges count for nothing."""
    rng = random.Random(6)
    pairs = [tuple(rng.sample(range(300), 2)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500), (501, None)]
    edges = materialise(spark.createDataFrame([*pairs, pairs[0]], "u long, v long"))
    got, jobs = {}, {}
    for few in (0, 40, 1 << 22):
        found, jobs[few] = _jobs(spark, lambda few=few: rows(components.components(edges, few)))
        got[few] = found
    assert got[0] == got[40] == got[1 << 22] and jobs[1 << 22] < jobs[40] < jobs[0]
    assert dict(got[0])[460] == 400 and 500 not in dict(got[0])


def test_uncut_components_are_searched_once(spark, monkeypatch):
    """Four components in four parts: no split cuts one, so that they are looked for once for all depths; where one is cut, blocks are as from a search of all."""
    found = []
    monkeypatch.setattr(kway, "graph_components", lambda e, n: found.append(n.count()) or components.graph_components(e, n))
    edges = materialise(spark.createDataFrame([(c * 10 + i, c * 10 + i + 1, 1.0) for c in range(4) for i in range(9)], "u long, v long, w double"))
    nodes = materialise(spark.range(40).selectExpr("id", "1.0D AS c"))
    part = dict(rows(kway.partition("recursive", edges, nodes, 4)))
    assert found == [40] and all(len({part[c * 10 + i] for i in range(10)}) == 1 for c in range(4)) and len(set(part.values())) == 4
    found.clear()
    one = rows(kway.by_depth(edges, nodes, 8, orders=kway.level_order))
    assert found == [40]
    searched = lambda e, n, b, seed: kway.level_order(e, n.select("id", "c"), b, seed)
    pairs = materialise(lattice.couplings(spark, 8, 3, 2))
    m = materialise(lattice.matrix(pairs, 1, "k"))
    edges = materialise(graph.matrix_to_graph(m, 1))
    assert len(one) == 40 and rows(kway.by_depth(edges, nodes, 6)) == rows(kway.by_depth(edges, nodes, 6, orders=searched))


def test_long_searches_make_steps_alone_where_many_are_reached(spark, monkeypatch):
    monkeypatch.setattr(components, "MANY", 3)
    pairs = [(i, j) for i in range(60) for j in range(i + 1, min(60, i + 4))]
    edges = spark.createDataFrame([(u, v, 1.0) for u, v in pairs], "u long, v long, w double")
    assert dict(rows(components.levels(edges, spark.createDataFrame([(0,)], "id long")))) == {i: -(-i // 3) for i in range(60)}


def test_searches_send_their_code_to_executors(spark, triangles):
    from graphband import session

    if hasattr(spark.sparkContext, session._SHIPPED):
        delattr(spark.sparkContext, session._SHIPPED)
    assert len(rows(kway.partition("levels", *triangles, 2))) == 6 and getattr(spark.sparkContext, session._SHIPPED)


def test_scores_are_those_of_every_partitioner(spark, monkeypatch):
    from graphband import queries_multilevel

    monkeypatch.setattr(kway, "partition", lambda name, e, n, *_, **__: n.selectExpr("id", "id % 4 AS p"))
    found = queries_multilevel.partitioner_scores(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["strategy"] for r in found) == sorted(kway.PARTITIONERS) and {r["parts"] for r in found} == {4}


@pytest.mark.parametrize("clashes", [True, False])
def test_refinement_in_a_task_near_the_boundary_and_in_joins(spark, monkeypatch, clashes):
    """The same moves pass after pass, with weights that are none, an end without a node and a part out of range; one task writes two tables for all passes."""
    rng = random.Random(1)
    drawn = [(rng.randrange(160), rng.choice([1, 2, 3, 5])) for _ in range(700)]
    pairs = sorted({(a, a + step) for a, step in drawn})
    edges = materialise(spark.createDataFrame([(u, v, float(rng.randint(-1, 9))) for u, v in pairs], "u long, v long, w double"))
    nodes = materialise(spark.createDataFrame([(i, None if i == 7 else float(rng.randint(1, 4))) for i in range(160) if i != 9], "id long, c double"))
    part = materialise(spark.range(160).selectExpr("id", "CASE WHEN id = 11 THEN 99L ELSE id * 4 div 160 END AS p"))
    written = []
    monkeypatch.setattr(partition, "materialise", lambda df: written.append(1) or materialise(df))
    got, tables = {}, {}
    for few in (0, 250, 1 << 22):
        written.clear()
        got[few] = rows(partition.refine(edges, nodes, part, 4, 0.25, 5, clashes=clashes, few=few))
        tables[few] = len(written)
    assert got[0] == got[250] == got[1 << 22] != rows(part) and tables[1 << 22] == 2 < tables[0]
    near, served = partition._surroundings(edges, part, 5, 250)
    assert 0 < served <= 5 and near.count() <= 250 < edges.count()


def test_figures_count_entries_once_and_matrices_stay(spark, monkeypatch):
    """All figures come from one count by distance, as the single ones have them; a check moves its positions, not the matrices."""
    k = materialise(spark.createDataFrame([(i, j, float(i + j)) for i in range(40) for j in range(40) if (i * j) % 3 == 0], "i long, j long, v double"))
    one, band, counted = metrics.shape(k, 40).first(), metrics.fixed_band(k).first(), []
    monkeypatch.setattr(metrics, "by_distance", lambda x, f=metrics.by_distance: counted.append(1) or f(x))
    found = metrics.long_figures(k, 40)
    got = {r["metric"]: r["value"] for r in found.collect()}
    assert counted == [1] and [got[x] for x in ("n", "nnz", "bandwidth", "avg_bandwidth")] == list(one) and (got["count_within_200"], got["frac_within_200"]) == tuple(band)
    assert sorted(v for m, v in got.items() if m.endswith("%")) == sorted(r["fraction"] for r in metrics.band_curve(k, 40).collect())
    assert metrics.long_figures(k.where("false"), 40).where("metric IN ('avg_bandwidth', 'nnz')").agg({"value": "sum"}).first()[0] == 0
    order = materialise(spark.range(40).selectExpr("id AS old", "39 - id AS new"))
    check = metrics.permutation_check(k, partition.permute(k, order), order, 40, 500)
    assert check._jdf.queryExecution().executedPlan().toString().count("LeftSemi, BuildRight") >= 2
    assert check.first()["mismatches"] == 0 and metrics.permutation_check(k, k, order, 40, 500).first()["mismatches"] > 0
