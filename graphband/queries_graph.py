"""Registered queries of components, spectral bisection, matching in visit order and colours, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband import queries as base
from graphband.operators import components, graph, kway, partition, results, spectral, tiles
from graphband.session import materialise, shared_dir, table
from graphband.sources import derived, mtx_source

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(map(materialise, base._graph(s, d)))


def _strong(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The derived graph with its rather heavy edges alone: several components and isolated nodes."""
    e, n = base._graph(s, d)
    return materialise(e.where("w >= 3 * 2000 AND (u + v) % 7 < 2")), materialise(n)


STRONG = f"{base.KM}{base.GRAPH}, se AS (SELECT * FROM e WHERE w >= 3 * 2000 AND (u + v) % 7 < 2), ss AS (SELECT u, v, w FROM se UNION ALL SELECT v, u, w FROM se)"
ROOTS = ", cc AS (SELECT id, min(root) AS comp FROM r GROUP BY id)"
REACHED = "r(id, root) AS (SELECT id, id FROM nodes UNION SELECT ss.v, r.root FROM r JOIN ss ON ss.u = r.id)"


@_add(f"WITH RECURSIVE {STRONG}, {REACHED}{ROOTS} SELECT id, comp FROM cc")
def graph_components(s, d):
    return components.graph_components(*_strong(s, d))


@_add(f"WITH RECURSIVE {STRONG}, {REACHED}{ROOTS}, w(id, root, level) AS (SELECT DISTINCT comp, comp, CAST(0 AS BIGINT) FROM cc UNION SELECT ss.v, w.root, w.level + 1 FROM w JOIN ss ON ss.u = w.id WHERE w.level < 60) SELECT id, min(level) AS level FROM w GROUP BY id")
def component_levels(s, d):
    """Steps from each component's smallest node, in all components at once."""
    e, n = _strong(s, d)
    comps = components.graph_components(e, n)
    return components.levels(e, comps.select(F.col("comp").alias("id")).distinct())


@_add(None)
def fiedler_bisection(s, d):
    """(id, x): the derived graph in two by its second eigenvector.  Tests hold it against a dense eigensolver."""
    e, n = _graph(s, d)
    half = n.agg(F.sum("c")).first()[0] / 2
    return kway.fiedler_bisection(e, n, half, 0)


@_add(f"WITH {base.KM}{base.GRAPH} SELECT CAST(0 AS BIGINT) AS comp, CAST(count(*) AS BIGINT) AS nodes, true AS resolved, true AS connected FROM nodes")
def fiedler_residuals(s, d):
    """For each component its nodes, whether the eigenvector's residual is below the bound, and whether its eigenvalue is below that of the known one."""
    e, n = _graph(s, d)
    y, told = spectral.fiedler(e, components.graph_components(e, n), rounds=60)
    sizes = y.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(told, "comp").select("comp", "nodes", (F.col("residual") <= spectral.RESIDUAL).alias("resolved"), (F.col("theta") < 1 - 1e-9).alias("connected"))


@_add(None)
def bisection_cuts(s, d):
    """(strategy, parts, cut, heaviest) of every partitioner on the derived graph, in four."""
    e, n = _graph(s, d)
    comps, rows = materialise(components.graph_components(e, n)), []
    for name in sorted(kway.PARTITIONERS):
        part = materialise(kway.partition(name, e, n, 4, 0.1, comps=comps))
        weight = partition.part_weights(n, part, 4).agg(F.max("weight").alias("heaviest"))
        one = partition.edge_cut(e, part).join(weight).join(part.agg(F.count_distinct("p").alias("parts")))  # one row each
        rows.append(one.select(F.lit(name).alias("strategy"), "parts", "cut", "heaviest"))
    return reduce(DataFrame.unionAll, rows)


def _visits(score: str, order: str, where: str = "") -> str:
    """A greedy pass, one visit after another, as a recursion over the order."""
    return (
        f"WITH RECURSIVE {base.KM}{base.GRAPH}, dg AS (SELECT n.id, coalesce(sum(w), 0) AS deg FROM nodes n LEFT JOIN sym ON sym.u = n.id GROUP BY n.id), vo AS (SELECT id, row_number() OVER (ORDER BY {order}) - 1 AS place FROM dg), "
        f"pf AS (SELECT s.u, list(s.v ORDER BY round({score}, 9) DESC, abs(s.w) DESC, (least(s.u, s.v) * 31 + greatest(s.u, s.v) * 17) % 1009 DESC, least(s.u, s.v) DESC, greatest(s.u, s.v) DESC) AS vs FROM sym s JOIN nodes a ON s.u = a.id JOIN nodes b ON s.v = b.id{where} GROUP BY s.u), "
        "pl AS (SELECT vo.place, vo.id, coalesce(pf.vs, []) AS vs FROM vo LEFT JOIN pf ON pf.u = vo.id), "
        "st(step, taken, mates) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL "
        "SELECT step + 1, CASE WHEN list_contains(taken, pl.id) THEN taken ELSE list_concat(taken, [pl.id, coalesce(list_filter(pl.vs, lambda x: NOT list_contains(taken, x))[1], pl.id)]) END, "
        "CASE WHEN list_contains(taken, pl.id) THEN mates ELSE list_concat(mates, [coalesce(list_filter(pl.vs, lambda x: NOT list_contains(taken, x))[1], pl.id), pl.id]) END FROM st JOIN pl ON pl.place = st.step), "
        "fin AS (SELECT taken, mates FROM st ORDER BY step DESC LIMIT 1) SELECT DISTINCT id, mate FROM (SELECT unnest(taken) AS id, unnest(mates) AS mate FROM fin)"
    )


@_add(_visits("abs(s.w)", "deg DESC, id"))
def visit_matching_sorted(s, d):
    return graph.visit_matching(*_graph(s, d), "sorted")


CAP = 150_000.0


@_add(_visits("abs(s.w)", "deg DESC, id", f" WHERE a.c + b.c <= {CAP}"))
def visit_matching_capped(s, d):
    """No supernode above a weight."""
    return graph.visit_matching(*_graph(s, d), "sorted", CAP)


PRIO = "({0} * 7919 + 104729) % 1000003"
BOUNDARY = f", bd AS (SELECT DISTINCT s.u AS id FROM sym s JOIN np a ON s.u = a.id JOIN np b ON s.v = b.id WHERE a.p <> b.p)"


@_add(
    f"WITH RECURSIVE {base.KM}{base.GRAPH}{base.NODEPART}{BOUNDARY}, dn AS (SELECT s.u, s.v FROM sym s JOIN bd a ON s.u = a.id JOIN bd b ON s.v = b.id WHERE ({PRIO.format('s.u')}, s.u) > ({PRIO.format('s.v')}, s.v)), "
    "co(id, colour) AS (SELECT id, CAST(0 AS BIGINT) FROM bd UNION SELECT dn.v, co.colour + 1 FROM co JOIN dn ON dn.u = co.id) SELECT id, max(colour) AS colour FROM co GROUP BY id"
)
def boundary_colours(s, d):
    e, n = _graph(s, d)
    return partition.colours(e, materialise(partition.boundary(e, base._parts(n))))


@_add(f"WITH {base.KM}{base.GRAPH} SELECT CAST(0 AS BIGINT) AS inside")
def colour_conflicts(s, d):
    """Edges inside a colour class: none."""
    e, n = _graph(s, d)
    c = materialise(partition.colours(e, materialise(partition.boundary(e, base._parts(n))))).withColumnRenamed("colour", "p")
    return partition.with_parts(e, c).where("pu = pv").agg(F.count(F.lit(1)).alias("inside"))


@_add(f"WITH {base.KM} SELECT i, j, v FROM k")
def mtx_round_trip(s, d):
    """The derived matrix written and read as the data source ``mtx``, in ranges of a quarter of a megabyte."""
    folder = shared_dir(s)
    mtx_source.register(s)
    derived.k_part(s, d).write.format("mtx").option("n", derived.size(s, d)).mode("overwrite").save(folder)
    return s.read.format("mtx").option("partition_bytes", 1 << 18).load(folder)


MORTON = " + ".join(f"(((ti >> {b}) & 1) << {2 * b + 1}) + (((tj >> {b}) & 1) << {2 * b})" for b in range(tiles.ZOOM))


@_add(
    f"WITH {base.KM}{base.GRAPH}{base.NODEPART}, zt AS (SELECT CAST(z AS BIGINT) AS zoom, i * (1 << z) // n AS ti, j * (1 << z) // n AS tj, coalesce(np.p, -1) AS p FROM k CROSS JOIN meta CROSS JOIN unnest(range(0, {tiles.ZOOM + 1})) AS t(z) LEFT JOIN np ON np.id = i // {base.D}), "
    "zc AS (SELECT zoom, ti, tj, p, count(*) AS n FROM zt GROUP BY ALL) "
    f"SELECT zoom, CAST({MORTON} AS BIGINT) AS code, CAST(ti AS BIGINT) AS row, CAST(tj AS BIGINT) AS col, CAST(sum(n) AS BIGINT) AS n, CAST(arg_max(p, n * 1000 - p) AS BIGINT) AS p FROM zc GROUP BY zoom, ti, tj"
)
def spy_tiles(s, d):
    """The derived matrix in tiles at seven zooms, with each tile's dominant part."""
    _, n = base._graph(s, d)
    return tiles.pyramid(derived.k_part(s, d), base._parts(n), derived.size(s, d), base.D)


@_add(f"WITH {base.KM}{base.GRAPH}{base.NODEPART}, o AS (SELECT id, p, row_number() OVER (ORDER BY p, id) - 1 AS new FROM np) SELECT CAST(new * {base.D} + r AS BIGINT) AS row, p FROM o, unnest(range(0, {base.D})) AS t(r)")
def permuted_labels(s, d):
    part = base._parts(base._graph(s, d)[1])
    return partition.permuted_labels(part, partition.node_order(part), base.D)


@_add("SELECT p_brand, CAST(row_number() OVER (ORDER BY min(p_partkey), p_brand) - 1 AS BIGINT) AS rank FROM part GROUP BY p_brand")
def ordered_brands(s, d):
    return results.ordered_unique(table(s, d, "part"), "p_brand", "p_partkey")


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
