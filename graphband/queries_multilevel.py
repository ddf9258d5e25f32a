"""Registered queries of the multilevel run and its parts, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband import queries as base
from graphband.functions.bands import band_label
from graphband.operators import components, graph, kway, metrics, partition, results
from graphband.plans import multilevel
from graphband.session import materialise
from graphband.sources import derived, lattice

Query = Callable[[SparkSession, str], DataFrame]
D, K, KM, GRAPH, PART, NODEPART, CAND, MATE, SIDE = base.D, base.K, base.KM, base.GRAPH, base.PART, base.NODEPART, base.CAND, base.MATE, base.SIDE

_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(map(materialise, base._graph(s, d)))


for _name, _score in (("random", "abs(s.w)"), ("light", "-abs(s.w)")):

    def _f(s, d, name=_name):
        return graph.candidates(*base._graph(s, d), name)

    _f.__name__ = f"hem_score_{_name}"
    _add(f"WITH {KM}{GRAPH} SELECT s.u, s.v, s.w, round({_score}, 9) AS score, (least(s.u, s.v) * 31 + greatest(s.u, s.v) * 17) % 1009 AS tie FROM sym s")(_f)


@_add(f"WITH {KM}{GRAPH}, dg AS (SELECT n.id, coalesce(sum(w), 0) AS deg FROM nodes n LEFT JOIN sym ON sym.u = n.id GROUP BY n.id) SELECT id, deg, CAST(row_number() OVER (ORDER BY deg DESC, id) - 1 AS BIGINT) AS place FROM dg")
def weighted_degree_order(s, d):
    return graph.visit_order(*_graph(s, d), "sorted")


QUAD = ", qd AS (SELECT e.u, e.v, 2 * (a.c / total) * (b.c / total) - 2 * e.w / scale AS q FROM e JOIN nodes a ON a.id = e.u JOIN nodes b ON b.id = e.v CROSS JOIN (SELECT sum(abs(w)) AS scale FROM e) CROSS JOIN (SELECT sum(c) AS total FROM nodes))"


@_add(f"WITH {KM}{GRAPH}{QUAD} SELECT u, v, round(q, 9) AS q FROM qd WHERE round(q, 9) <> 0")
def qubo_quadratic(s, d):
    return partition.qubo_quadratic(*_graph(s, d))


@_add(f"WITH {KM}{GRAPH}{QUAD} SELECT u, v, round(q / 4, 9) AS j FROM qd WHERE round(q / 4, 9) <> 0")
def ising_couplings(s, d):
    return partition.ising_couplings(*_graph(s, d))


@_add(f"WITH {KM}{GRAPH}, sm AS (SELECT unnest(range(0, 6)) AS sample), sd AS (SELECT sample, id, ((id * (2 * sample + 3) + sample) // 7) % 2 AS x FROM nodes, sm), tot AS (SELECT sum(abs(w)) AS scale FROM e), wt AS (SELECT sum(c) AS total FROM nodes), q AS (SELECT a.sample, sum(2 * (n1.c / total) * (n2.c / total) - 2 * coalesce(e.w, 0) / scale) AS q FROM nodes n1 JOIN nodes n2 ON n1.id < n2.id JOIN sd a ON a.id = n1.id AND a.x = 1 JOIN sd b ON b.id = n2.id AND b.x = 1 AND a.sample = b.sample LEFT JOIN e ON e.u = n1.id AND e.v = n2.id CROSS JOIN tot CROSS JOIN wt GROUP BY a.sample), l AS (SELECT sample, sum(x * (coalesce(g.deg, 0) / scale + (c / total) * (c / total) - c / total)) AS l FROM nodes JOIN sd USING (id) LEFT JOIN (SELECT u AS id, sum(w) AS deg FROM sym GROUP BY u) g USING (id) CROSS JOIN tot CROSS JOIN wt GROUP BY sample) SELECT CAST(sample AS BIGINT) AS sample, round(l + q, 6) AS energy FROM l JOIN q USING (sample)")
def qubo_energy_samples(s, d):
    e, n = _graph(s, d)
    sides = n.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("sample")).withColumn("x", F.expr("((id * (2 * sample + 3) + sample) div 7) % 2"))
    return partition.bisection_energies(e, n, sides).select("sample", F.round("energy", 6).alias("energy"))


@_add(f"WITH {KM}{GRAPH}{NODEPART} SELECT p, CAST(sum(c) AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS n FROM nodes JOIN np USING (id) GROUP BY p HAVING count(*) > 1 ORDER BY weight DESC, p LIMIT 1")
def heaviest_block(s, d):
    e, n = _graph(s, d)
    return kway.heaviest_block(n, base._parts(n))


STARTS = ["id % 25", "(id * 7 + 3) % 25", "(id // 20) % 25"]
START_SQL = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS start, (SELECT sum(CASE WHEN a.p <> b.p THEN w ELSE 0 END) FROM e JOIN (SELECT id, {p} AS p FROM nodes) a ON e.u = a.id JOIN (SELECT id, {p} AS p FROM nodes) b ON e.v = b.id) / greatest((SELECT sum(w) FROM e), 1) + (SELECT sum(greatest(0, CAST(0.98 AS DOUBLE) * share - weight, weight - CAST(1.02 AS DOUBLE) * share)) FROM (SELECT coalesce(CAST(sum(c) AS DOUBLE), 0) AS weight FROM unnest(range(0, 25)) AS t(p) LEFT JOIN nodes ON {p} = t.p GROUP BY t.p), (SELECT sum(c) / 25 AS share FROM nodes)) / greatest((SELECT sum(c) FROM nodes), 1) AS score"
    for i, p in enumerate(STARTS)
)


@_add(f"WITH {KM}{GRAPH} SELECT start, round(score, 9) AS score, start = (SELECT arg_min(start, score) FROM ({START_SQL})) AS best FROM ({START_SQL})")
def best_start_selection(s, d):
    e, n = _graph(s, d)
    starts = [n.select("id", F.expr(p.replace("//", "div")).cast("long").alias("p")) for p in STARTS]
    _, table = kway.best_start(e, n, starts, K, 2)
    best = table.agg(F.min_by("start", F.struct("score", "start")).alias("b"))  # one row
    return table.join(best).select("start", F.round("score", 9).alias("score"), (F.col("start") == F.col("b")).alias("best"))


SCORES = ", pw AS (SELECT p, CAST(sum(c) AS DOUBLE) AS weight FROM nodes JOIN np USING (id) GROUP BY p), sh AS (SELECT sum(weight) / 25 AS share FROM pw), co AS (SELECT s.u AS id, b.p, sum(w) AS w FROM sym s JOIN np b ON s.v = b.id GROUP BY 1, 2), sc AS (SELECT co.id, np.p AS source, co.p AS target, nodes.c, co.w - coalesce(h.w, 0) AS gain, a.weight AS wa, b.weight AS wb FROM co JOIN np ON co.id = np.id AND co.p <> np.p JOIN nodes ON nodes.id = co.id LEFT JOIN co h ON h.id = np.id AND h.p = np.p JOIN pw a ON a.p = np.p JOIN pw b ON b.p = co.p CROSS JOIN sh WHERE a.weight - nodes.c >= CAST(0.8 AS DOUBLE) * share AND b.weight + nodes.c <= CAST(1.2 AS DOUBLE) * share)"


@_add(f"WITH {KM}{GRAPH}{NODEPART}{SCORES}, z AS (SELECT *, gain - CAST(0.0001 AS DOUBLE) * 2 * c * (wb - wa + c) AS score FROM sc) SELECT id, source, target, gain, round(score, 6) AS score FROM z WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, target) = 1")
def move_gain_balance(s, d):
    e, n = _graph(s, d)
    moves = partition.move_scores(e, n, base._parts(n), K, 20, "cut_balance", 0.0001)
    return partition.best_by_score(moves).withColumn("score", F.round("score", 6))


ADMITTED = ", bm AS (SELECT * FROM sc WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY gain DESC, target) = 1), im AS (SELECT * FROM bm WHERE id NOT IN (SELECT s.u FROM sym s JOIN bm a ON s.u = a.id JOIN bm b ON s.v = b.id WHERE b.gain > a.gain OR (b.gain = a.gain AND b.id > a.id))), ru AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY gain DESC, id ROWS UNBOUNDED PRECEDING) AS leaves, sum(c) OVER (PARTITION BY target ORDER BY gain DESC, id ROWS UNBOUNDED PRECEDING) AS enters FROM im), ad AS (SELECT id, source, target, gain FROM ru CROSS JOIN sh WHERE leaves <= wa - CAST(0.8 AS DOUBLE) * share AND enters <= CAST(1.2 AS DOUBLE) * share - wb)"


@_add(f"WITH {KM}{GRAPH}{NODEPART}{SCORES}{ADMITTED} SELECT * FROM ad")
def admitted_moves(s, d):
    e, n = _graph(s, d)
    return partition.admitted_moves(e, n, base._parts(n), K, 20).drop("score")


@_add(f"WITH {KM}{GRAPH}{NODEPART}{SCORES}{ADMITTED}, af AS (SELECT np.id, coalesce(ad.target, np.p) AS p FROM np LEFT JOIN ad ON ad.id = np.id) SELECT (SELECT sum(CASE WHEN a.p <> b.p THEN w ELSE 0 END) FROM e JOIN np a ON e.u = a.id JOIN np b ON e.v = b.id) AS before, (SELECT sum(CASE WHEN a.p <> b.p THEN w ELSE 0 END) FROM e JOIN af a ON e.u = a.id JOIN af b ON e.v = b.id) AS after")
def refined_cut_one_pass(s, d):
    e, n = _graph(s, d)
    part = base._parts(n)
    after = partition.refine(e, n, part, K, 20, passes=1)
    return partition.edge_cut(e, part).withColumnRenamed("cut", "before").join(partition.edge_cut(e, after).withColumnRenamed("cut", "after"))  # one row each


@_add(f"WITH {KM}{GRAPH}{CAND}{MATE} SELECT id, coarse % 25 AS p FROM lab")
def project_partition(s, d):
    _, _, labels = base._labels(s, d)
    labels = materialise(labels)
    coarse = labels.select(F.col("coarse").alias("id"), (F.col("coarse") % 25).alias("p")).distinct()
    return partition.project(labels, coarse)


@_add(f"WITH {KM}, pts AS (SELECT CAST(x AS BIGINT) * 5 AS hundredths, CAST(x AS DOUBLE) * CAST(5.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS pc FROM unnest(range(0, 100)) AS t(x)) SELECT hundredths, CASE WHEN hundredths % 100 = 0 THEN printf('%.1f', pc) ELSE rtrim(rtrim(printf('%.10f', pc), '0'), '.') END || '%' AS label, CAST(CASE WHEN hundredths = 0 THEN 0 ELSE greatest(1, ceil(pc / CAST(100.0 AS DOUBLE) * CAST((SELECT n FROM meta) AS DOUBLE))) END AS BIGINT) AS width FROM pts")
def band_labels(s, d):
    curve = metrics.band_curve(derived.k_part(s, d), derived.size(s, d))
    return curve.select("hundredths", band_label(F.col("hundredths") / F.lit(100.0)).alias("label"), "width")


def _curve(cte: str) -> str:
    return f"SELECT 'frac_within_' || CASE WHEN x % 20 = 0 THEN printf('%.1f', x * 5.0 / 100) ELSE rtrim(rtrim(printf('%.10f', x * 5.0 / 100), '0'), '.') END || '%' AS metric, round(CAST((SELECT count(*) FROM {cte} WHERE abs(i - j) <= CASE WHEN x = 0 THEN 0 ELSE greatest(1, ceil(CAST(x AS DOUBLE) * CAST(5.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) * CAST((SELECT n FROM meta) AS DOUBLE))) END) AS DOUBLE) / (SELECT count(*) FROM {cte}), 9) AS value FROM unnest(range(0, 100)) AS t(x)"


def _figures(matrix: str, variant: str, cte: str) -> str:
    shape = f"SELECT unnest(['n', 'nnz', 'bandwidth', 'avg_bandwidth', 'count_within_200', 'frac_within_200']) AS metric, unnest([CAST((SELECT n FROM meta) AS DOUBLE), CAST(count(*) AS DOUBLE), CAST(max(abs(i - j)) AS DOUBLE), round(CAST(sum(abs(i - j)) AS DOUBLE) / count(*), 6), CAST(count(*) FILTER (abs(i - j) <= 200) AS DOUBLE), round(CAST(count(*) FILTER (abs(i - j) <= 200) AS DOUBLE) / count(*), 9)]) AS value FROM {cte}"
    return f"SELECT '{matrix}' AS matrix, '{variant}' AS variant, metric, value FROM ({shape} UNION ALL {_curve(cte)})"


@_add(f"WITH {KM}{PART}, pq AS (SELECT a.new AS i, b.new AS j, v FROM m JOIN ord a ON m.i = a.old JOIN ord b ON m.j = b.old) " + " UNION ALL ".join(_figures(*x) for x in (("K", "original", "k"), ("K", "permuted", "pm"), ("M", "original", "m"), ("M", "permuted", "pq"))))
def figures_bundle(s, d):
    order = materialise(partition.node_order(derived.p_brand(s, d)))
    k, m = materialise(derived.k_part(s, d)), materialise(derived.m_part(s, d))
    return metrics.bundle({"K": (k, partition.permute(k, order)), "M": (m, partition.permute(m, order))}, order, derived.size(s, d)).where("variant <> 'check'")


@_add(f"WITH {KM}, pts AS (SELECT CAST(x AS BIGINT) * 5 AS hundredths FROM unnest(range(0, 100)) AS t(x)) SELECT hundredths, CAST(CASE WHEN hundredths = 0 THEN 0 ELSE greatest(1, ceil(CAST(hundredths AS DOUBLE) / CAST(100.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) * CAST((SELECT n FROM meta) AS DOUBLE))) END AS BIGINT) AS width FROM pts WHERE hundredths % 10 = 0 OR hundredths = 495")
def curve_thinned(s, d):
    curve = metrics.band_curve(derived.k_part(s, d), derived.size(s, d)).withColumn("run", F.lit(0))
    return results.thinned(curve, ["run"], "hundredths", 50).select("hundredths", "width")


def _lattice_sql(kind: str, d: int = 3) -> str:
    jit = lambda salt, w: f"(1 + CAST((lo * 7919 + hi * 104729 + {salt}) % {2 * w + 1} - {w} AS DOUBLE) / CAST(1000.0 AS DOUBLE))"
    value, same, other, share, grow, add = {"k": (f"-(CAST(210.0 AS DOUBLE) / d2 * {jit(1, 80)})", 1.0, 0.28, 1.0, 1.15, 100.0), "m": (f"(CAST(7.8 AS DOUBLE) / (d2 * sqrt(d2)) * {jit(2, 50)})", 0.35, 0.08, 1.5, 1.25, 10.0)}[kind]
    num = lambda x: f"CAST({x} AS DOUBLE)"
    return (
        "WITH sz AS (SELECT greatest(1, count(*) // 20) AS nx, 5 AS ny, 4 AS nz FROM part), cells AS (SELECT c, nx, (c * 37 + c // nx * 13) % (nx * 20) AS key FROM sz, unnest(range(0, nx * 20)) AS t(c)), "
        "num AS (SELECT row_number() OVER (ORDER BY key, c) - 1 AS cell, c AS node, nx FROM cells), pos AS (SELECT node, cell % nx AS x, cell // nx % 5 AS y, cell // (nx * 5) AS z, nx FROM num), "
        "off AS (SELECT a AS dx, b AS dy, c AS dz FROM unnest(range(-1, 2)) AS t(a), unnest(range(-1, 2)) AS u(b), unnest(range(-1, 2)) AS v(c) WHERE a > 0 OR (a = 0 AND (b > 0 OR (b = 0 AND c > 0)))), "
        "pr AS (SELECT least(p.node, q.node) AS lo, greatest(p.node, q.node) AS hi, CAST(abs(dx) + abs(dy) + abs(dz) AS DOUBLE) AS d2 FROM pos p CROSS JOIN off JOIN pos q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz), "
        f"bl AS (SELECT lo * {d} + a AS i, hi * {d} + b AS j, {value} * CASE WHEN a = b THEN {num(same)} ELSE {num(other)} END AS v FROM pr, unnest(range(0, {d})) AS t(a), unnest(range(0, {d})) AS u(b)), "
        f"bo AS (SELECT i, j, v FROM bl UNION ALL SELECT j, i, v FROM bl) SELECT i, j, round(v, 6) AS v FROM bo UNION ALL SELECT i, i, round(sum(abs(v)) * {num(share)} * {num(grow)} + {num(add)}, 6) FROM bo GROUP BY i"
    )


@_add(_lattice_sql("k"))
def lattice_k(s, d):
    return lattice.of_parts(s, d, "k").withColumn("v", F.round("v", 6))


@_add(_lattice_sql("m"))
def lattice_m(s, d):
    return lattice.of_parts(s, d, "m").withColumn("v", F.round("v", 6))


PASSES = 50  # refinement ends before, when no move is left


def _settings(n: int) -> multilevel.Settings:
    return multilevel.Settings(dof=D, inferior=max(40, n // D // 8), superior=max(80, n // D // 3), k=4, tolerance=0.2, passes=PASSES, refinement="clashes")


@_add(None)
def multilevel_locality(s, d):
    """The whole run over the derived matrices: sizes, cut, balance, bandwidth before and after.  Tests hold its invariants."""
    n = derived.size(s, d)
    return multilevel.summary(multilevel.run({"K": derived.k_part(s, d), "M": derived.m_part(s, d)}, n, _settings(n)))


@_add(None)
def multilevel_lattice(s, d):
    """The whole run over the lattice of about one node a part, three rows each."""
    nx, ny, nz = lattice.shape(derived.size(s, d))
    pairs = materialise(lattice.couplings(s, nx, ny, nz))
    n = nx * ny * nz
    settings = multilevel.Settings(dof=3, inferior=max(20, n // 70), superior=max(40, n // 40), k=4, tolerance=0.1, passes=PASSES, refinement="clashes")
    return multilevel.summary(multilevel.run({x.upper(): lattice.matrix(pairs, 3, x) for x in "km"}, 3 * n, settings))


@_add(None)
def partitioner_scores(s, d):
    """(strategy, parts, cut, score) of each partitioner on the derived graph."""
    e, n = _graph(s, d)
    comps, rows = materialise(components.graph_components(e, n)), []
    for name in sorted(kway.PARTITIONERS):
        part = materialise(kway.partition(name, e, n, 4, 0.1, comps=comps))
        one = partition.edge_cut(e, part).join(partition.partition_score(e, n, part, 4, 0.1, 1.0)).join(part.agg(F.count_distinct("p").alias("parts")))  # one row each
        rows.append(one.select(F.lit(name).alias("strategy"), "parts", "cut", "score"))
    return reduce(DataFrame.unionAll, rows)


@_add(None)
def coarsening_preview(s, d):
    """What each level of a coarsening is like, whether it is accepted, and why it ends."""
    e, n = _graph(s, d)
    count = n.count()
    out = graph.chain(e, n, max(20, count // 10), max(40, count // 4), cap=graph.weight_cap(n, 4).first()["cap"])
    return s.createDataFrame([tuple(x.values()) for x in out.levels], graph.LEVEL).select("*", F.lit(out.reason).alias("stop_reason"), F.lit(out.reachable).alias("reachable"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}


