"""Registered queries of the graph and matrix operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband.operators import graph, metrics, partition, results
from graphband.plans import locality
from graphband.session import materialise
from graphband.sources import derived
from graphband.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
D, K = 4, 25

#: Common table expressions, in DuckDB's SQL.
PAIRS = "li AS (SELECT l_orderkey, CAST(l_partkey AS BIGINT) AS pk, CAST(l_quantity AS DOUBLE) AS q FROM lineitem WHERE l_quantity >= 40), pairs AS (SELECT a.pk AS i, b.pk AS j, a.q * b.q AS w FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey)"
KM = PAIRS + ", k AS (SELECT i, j, sum(w) AS v FROM pairs GROUP BY i, j), m AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS v FROM pairs GROUP BY i, j), meta AS (SELECT count(*) AS n FROM part)"
PART = ", brand AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p FROM part), ord AS (SELECT id AS old, CAST(row_number() OVER (ORDER BY p, id) - 1 AS BIGINT) AS new FROM brand), pm AS (SELECT a.new AS i, b.new AS j, v FROM k JOIN ord a ON k.i = a.old JOIN ord b ON k.j = b.old)"
GRAPH = f", e AS (SELECT least(i // {D}, j // {D}) AS u, greatest(i // {D}, j // {D}) AS v, sum(abs(v)) AS w FROM k WHERE i // {D} <> j // {D} GROUP BY 1, 2 HAVING sum(abs(v)) <> 0), nodes AS (SELECT r.id, coalesce(s.c, 0) AS c FROM (SELECT unnest(range(0, (SELECT n // {D} FROM meta))) AS id) r LEFT JOIN (SELECT i // {D} AS id, sum(v) AS c FROM k WHERE i = j GROUP BY 1) s ON r.id = s.id), sym AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e)"
NODEPART = f", np AS (SELECT id, id % {K} AS p FROM nodes)"
CAND = ", cand AS (SELECT s.u, s.v, s.w, round(CASE WHEN a.c > 0 AND b.c > 0 THEN abs(s.w) / sqrt(a.c * b.c) ELSE abs(s.w) END, 9) AS score, (least(s.u, s.v) * 31 + greatest(s.u, s.v) * 17) % 1009 AS tie FROM sym s JOIN nodes a ON s.u = a.id JOIN nodes b ON s.v = b.id), best AS (SELECT u, v FROM cand QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, abs(w) DESC, tie DESC, least(u, v) DESC, greatest(u, v) DESC) = 1)"
MATE = ", mp AS (SELECT x.u AS a, x.v AS b FROM best x JOIN best y ON x.u = y.v AND x.v = y.u WHERE x.u < x.v), mate AS (SELECT n.id, coalesce(l.b, r.a, n.id) AS mate FROM nodes n LEFT JOIN mp l ON n.id = l.a LEFT JOIN mp r ON n.id = r.b), lab AS (SELECT id, CAST(dense_rank() OVER (ORDER BY least(id, mate)) - 1 AS BIGINT) AS coarse FROM mate)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return locality.fold(spark, sf_dir, D)


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, nodes and labels after one round of mutual best."""
    e, n = map(materialise, _graph(spark, sf_dir))
    pairs = materialise(graph.mutual_round(graph.candidates(e, n)))
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("mate")).unionAll(pairs.select(F.col("b").alias("id"), F.col("a").alias("mate")))
    mates = n.select("id").join(both, "id", "left").select("id", F.coalesce("mate", "id").alias("mate"))
    return e, n, graph.supernodes(mates)


def _parts(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", (F.col("id") % K).alias("p"))


_ALL: dict[str, tuple[Query, str]] = {}


def _add(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


@_add(f"WITH {KM} SELECT i, j, v FROM k")
def coo_dedup_sum(s, d):
    return derived.k_part(s, d)


@_add(f"WITH {KM} SELECT i, j, v FROM m")
def coo_mass(s, d):
    return derived.m_part(s, d)


@_add(f"WITH {KM}{GRAPH} SELECT u, v, w FROM e")
def dof_fold_graph(s, d):
    return _graph(s, d)[0]


@_add(f"WITH {KM}{GRAPH} SELECT id, CAST(c AS DOUBLE) AS c FROM nodes")
def node_weight_diag(s, d):
    return _graph(s, d)[1]


@_add(f"WITH {KM}{GRAPH} SELECT u AS id, sum(w) AS deg FROM sym GROUP BY u")
def weighted_degree(s, d):
    return graph.weighted_degrees(_graph(s, d)[0])


@_add(f"WITH {KM}{GRAPH} SELECT CAST(1.5 AS DOUBLE) * sum(c) / {K} AS cap FROM nodes")
def auto_weight_cap(s, d):
    return graph.weight_cap(_graph(s, d)[1], K)


@_add(f"WITH {KM}{GRAPH}{CAND} SELECT u, v, w, score, tie FROM cand")
def hem_score_modified(s, d):
    return graph.candidates(*_graph(s, d))


@_add(f"WITH {KM}{GRAPH}{CAND} SELECT u, v FROM best")
def hem_best_candidate(s, d):
    return graph.best_candidates(graph.candidates(*_graph(s, d)))


@_add(f"WITH {KM}{GRAPH}{CAND}{MATE} SELECT a, b FROM mp")
def hem_mutual_round(s, d):
    return graph.mutual_round(graph.candidates(*_graph(s, d)))


@_add(f"WITH {KM}{GRAPH}{CAND}{MATE} SELECT id, coarse FROM lab")
def supernode_labels(s, d):
    return _labels(s, d)[2]


@_add(f"WITH {KM}{GRAPH}{CAND}{MATE} SELECT least(a.coarse, b.coarse) AS u, greatest(a.coarse, b.coarse) AS v, sum(abs(w)) AS w FROM e JOIN lab a ON e.u = a.id JOIN lab b ON e.v = b.id WHERE a.coarse <> b.coarse GROUP BY 1, 2")
def contract_edges(s, d):
    e, _, labels = _labels(s, d)
    return graph.contract_edges(e, labels)


@_add(f"WITH {KM}{GRAPH}{CAND}{MATE} SELECT coarse AS id, CAST(sum(c) AS DOUBLE) AS c FROM nodes JOIN lab USING (id) GROUP BY coarse")
def contract_nodes(s, d):
    _, n, labels = _labels(s, d)
    return graph.contract_nodes(n, labels)


@_add(f"WITH {KM}{GRAPH}{NODEPART} SELECT sum(CASE WHEN a.p <> b.p THEN w ELSE 0 END) AS cut FROM e JOIN np a ON e.u = a.id JOIN np b ON e.v = b.id")
def edge_cut(s, d):
    e, n = _graph(s, d)
    return partition.edge_cut(e, _parts(n))


@_add(f"WITH {KM}{GRAPH}{NODEPART}, pw AS (SELECT p, CAST(sum(c) AS DOUBLE) AS weight FROM nodes JOIN np USING (id) GROUP BY p), sh AS (SELECT sum(weight) / {K} AS share FROM pw) SELECT p, weight, round(CAST(0.98 AS DOUBLE) * share, 6) AS lower, round(CAST(1.02 AS DOUBLE) * share, 6) AS upper FROM pw, sh")
def part_weight_bounds(s, d):
    _, n = _graph(s, d)
    b = partition.bounds(partition.part_weights(n, _parts(n), K), K, 2)
    return b.select("p", "weight", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@_add(f"WITH {KM}{GRAPH}{NODEPART}, pw AS (SELECT p, CAST(sum(c) AS DOUBLE) AS weight FROM nodes JOIN np USING (id) GROUP BY p), sh AS (SELECT sum(weight) / {K} AS share FROM pw) SELECT round(sum(greatest(0, CAST(0.98 AS DOUBLE) * share - weight, weight - CAST(1.02 AS DOUBLE) * share)), 6) AS violation FROM pw, sh")
def balance_violation(s, d):
    _, n = _graph(s, d)
    return partition.balance_violation(n, _parts(n), K, 2).select(F.round("violation", 6).alias("violation"))


@_add(f"WITH {KM}{GRAPH}{NODEPART}, pw AS (SELECT p, CAST(sum(c) AS DOUBLE) AS weight FROM nodes JOIN np USING (id) GROUP BY p), sh AS (SELECT sum(weight) / {K} AS share FROM pw), vi AS (SELECT sum(greatest(0, CAST(0.98 AS DOUBLE) * share - weight, weight - CAST(1.02 AS DOUBLE) * share)) AS x FROM pw, sh), cu AS (SELECT sum(CASE WHEN a.p <> b.p THEN w ELSE 0 END) AS cut FROM e JOIN np a ON e.u = a.id JOIN np b ON e.v = b.id) SELECT round(cut / greatest((SELECT sum(w) FROM e), 1) + x / greatest((SELECT sum(c) FROM nodes), 1), 9) AS score FROM vi, cu")
def partition_score(s, d):
    e, n = _graph(s, d)
    return partition.partition_score(e, n, _parts(n), K, 2, 1.0).select(F.round("score", 9).alias("score"))


@_add(f"WITH {KM}{GRAPH}, l AS (SELECT min(c) AS least FROM nodes WHERE c > 0) SELECT id, CAST(greatest(1, least(1000000, round_even(c * CASE WHEN least < 1 THEN 1 / least ELSE 1 END, 0))) AS BIGINT) AS weight FROM nodes, l")
def metis_int_weights(s, d):
    return partition.integer_weights(_graph(s, d)[1])


@_add(f"WITH {KM}{GRAPH}, x AS (SELECT u AS id, CAST(count(*) AS BIGINT) AS degree, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS neighbours, string_agg(CAST(CAST(w AS BIGINT) AS VARCHAR), ',' ORDER BY v) AS weights FROM sym GROUP BY u) SELECT *, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM x")
def csr_adjacency(s, d):
    return partition.adjacency(_graph(s, d)[0])


@_add(f"WITH {KM}{GRAPH}, dg AS (SELECT u AS id, sum(w) AS deg FROM sym GROUP BY u) SELECT n.id, round(coalesce(deg, 0) / (SELECT sum(abs(w)) FROM e) + (c / (SELECT sum(c) FROM nodes)) * (c / (SELECT sum(c) FROM nodes) - CAST(1 AS DOUBLE)), 9) AS q FROM nodes n LEFT JOIN dg ON n.id = dg.id")
def qubo_linear(s, d):
    return partition.qubo_linear(*_graph(s, d))


@_add(f"WITH {KM}{GRAPH}{NODEPART} SELECT DISTINCT s.u AS id FROM sym s JOIN np a ON s.u = a.id JOIN np b ON s.v = b.id WHERE a.p <> b.p")
def boundary_nodes(s, d):
    e, n = _graph(s, d)
    return partition.boundary(e, _parts(n))


@_add(f"WITH {KM}{GRAPH}{NODEPART} SELECT s.u AS id, b.p, sum(w) AS w FROM sym s JOIN np b ON s.v = b.id GROUP BY 1, 2")
def part_connectivity(s, d):
    e, n = _graph(s, d)
    return partition.connectivity(e, _parts(n))


@_add(f"WITH {KM}{GRAPH}{NODEPART}, co AS (SELECT s.u AS id, b.p, sum(w) AS w FROM sym s JOIN np b ON s.v = b.id GROUP BY 1, 2), mv AS (SELECT co.id, np.p AS source, co.p AS target, co.w - coalesce(h.w, 0) AS gain FROM co JOIN np ON co.id = np.id AND co.p <> np.p LEFT JOIN co h ON h.id = np.id AND h.p = np.p) SELECT id, source, target, gain FROM mv QUALIFY row_number() OVER (PARTITION BY id ORDER BY gain DESC, target) = 1 AND gain > 0")
def move_gain_cut(s, d):
    e, n = _graph(s, d)
    return partition.best_moves(e, _parts(n))


@_add(f"WITH {KM}{PART} SELECT old, new FROM ord")
def node_permutation(s, d):
    return partition.node_order(derived.p_brand(s, d))


@_add(f"WITH {KM}{PART} SELECT old * 3 + r AS old, new * 3 + r AS new FROM ord, unnest(range(0, 3)) AS t(r)")
def dof_permutation(s, d):
    return partition.expand(partition.node_order(derived.p_brand(s, d)), 3)


@_add(f"WITH {KM}{PART} SELECT i, j, v FROM pm")
def permuted_coo(s, d):
    return partition.permute(derived.k_part(s, d), partition.node_order(derived.p_brand(s, d)))


SHAPE = "CAST((SELECT n FROM meta) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS nnz, CAST(coalesce(max(abs(i - j)), 0) AS BIGINT) AS bandwidth, round(coalesce(CAST(sum(abs(i - j)) AS DOUBLE) / count(*), 0), 6) AS avg_bandwidth"


@_add(f"WITH {KM} SELECT {SHAPE} FROM k")
def matrix_shape_stats(s, d):
    return metrics.shape(derived.k_part(s, d), derived.size(s, d))


@_add(f"WITH {KM} SELECT CAST(count(*) FILTER (abs(i - j) <= 200) AS BIGINT) AS within, round(CAST(count(*) FILTER (abs(i - j) <= 200) AS DOUBLE) / count(*), 9) AS fraction FROM k")
def band_fixed_200(s, d):
    return metrics.fixed_band(derived.k_part(s, d))


@_add(f"WITH {KM}, pts AS (SELECT CAST(x AS BIGINT) * 5 AS hundredths, CAST(CASE WHEN x = 0 THEN 0 ELSE greatest(1, ceil(CAST(x AS DOUBLE) * CAST(5.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) * CAST((SELECT n FROM meta) AS DOUBLE))) END AS BIGINT) AS width FROM unnest(range(0, 100)) AS t(x)), h AS (SELECT abs(i - j) AS dist, count(*) AS c FROM k GROUP BY 1) SELECT hundredths, width, CAST(coalesce(sum(c), 0) AS BIGINT) AS within, round(CAST(coalesce(sum(c), 0) AS DOUBLE) / (SELECT count(*) FROM k), 9) AS fraction FROM pts LEFT JOIN h ON h.dist <= pts.width GROUP BY 1, 2")
def band_curve_100(s, d):
    return metrics.band_curve(derived.k_part(s, d), derived.size(s, d))


@_add(f"WITH {KM}{PART}, a AS (SELECT {SHAPE} FROM k), b AS (SELECT {SHAPE} FROM pm) SELECT a.bandwidth AS bandwidth_original, b.bandwidth AS bandwidth_permuted, a.avg_bandwidth AS avg_original, b.avg_bandwidth AS avg_permuted, round((1 - CAST(b.bandwidth AS DOUBLE) / nullif(a.bandwidth, 0)) * 100, 6) AS bandwidth_reduction, round((1 - (CAST(b.bandwidth AS DOUBLE) / nullif(a.bandwidth, 0)) * (CAST(b.bandwidth AS DOUBLE) / nullif(a.bandwidth, 0))) * 100, 6) AS nb2_reduction FROM a, b")
def locality_before_after(s, d):
    return locality.before_after(s, d)


@_add(f"WITH {KM}{PART}, s AS (SELECT id, (id * 7919 + id // 7) % n AS i, (id * 104729 + (id * id) % 1009) % n AS j FROM unnest(range(0, 20000)) AS t(id), meta), x AS (SELECT coalesce(k.v, 0) AS v, coalesce(pm.v, 0) AS pv FROM s JOIN ord a ON s.i = a.old JOIN ord b ON s.j = b.old LEFT JOIN k ON k.i = s.i AND k.j = s.j LEFT JOIN pm ON pm.i = a.new AND pm.j = b.new) SELECT CAST(count(*) AS BIGINT) AS samples, CAST(count(*) FILTER (v <> pv) AS BIGINT) AS mismatches, CAST(coalesce(max(abs(v - pv)) FILTER (v <> pv), 0) AS DOUBLE) AS max_abs_err, CAST(sum(v) AS DOUBLE) AS sum_sampled FROM x")
def permutation_check(s, d):
    k, order = materialise(derived.k_part(s, d)), partition.node_order(derived.p_brand(s, d))
    return metrics.permutation_check(k, partition.permute(k, order), order, derived.size(s, d), 20_000)


LOGS = (
    "bare AS (SELECT *, CASE WHEN event_id % 13 = 5 THEN 'Error: step ' || event_id WHEN event_id % 17 = 3 THEN 'run.py:7: UserWarning: slow' WHEN event_id % 29 = 4 THEN 'Traceback (most recent call last):' END AS bare, (event_id // 7) % 5 + 1 AS k FROM events), "
    "raw AS (SELECT CAST(user_id AS BIGINT) AS job_id, CAST(event_id AS BIGINT) AS seq, CASE WHEN bare IS NULL THEN date_trunc('second', CAST(ts AS TIMESTAMP)) END AS ts, "
    "CASE WHEN event_id % 13 = 5 THEN 'ERROR' WHEN event_id % 17 = 3 THEN 'WARNING' WHEN event_id % 29 = 4 THEN 'ERROR' WHEN value > 90 THEN 'ERROR' WHEN value > 75 THEN 'WARNING' WHEN event_id % 3 = 0 THEN 'VERBOSE' ELSE 'INFO' END AS level, "
    "coalesce(bare, list_extract(['Converting matrices to graphs', 'Coarsening Heavy Edge Matching', 'Multilevel Partitioning Scheme using METIS', 'Uncoarsening Kernighan-Lin', 'Permuting matrices'], CAST(k AS INTEGER)) || ' #' || CAST(event_id AS VARCHAR)) AS message, "
    "CASE WHEN bare IS NULL THEN list_extract(['initialization', 'coarsening', 'partitioning', 'uncoarsening', 'permutation'], CAST(k AS INTEGER)) END AS stage FROM bare)"
)


@_add(f"WITH {LOGS} SELECT job_id, seq, coalesce(epoch(ts)::BIGINT, -1) AS at, level, message, stage FROM raw")
def log_parse(s, d):
    return logs.parse(derived.log_lines(s, d)).select("job_id", "seq", F.coalesce(F.unix_timestamp("ts"), F.lit(-1)).alias("at"), "level", "message", "stage")


@_add(f"WITH {LOGS}, x AS (SELECT *, lead(ts) OVER w AS until, lag(stage) OVER w AS last FROM raw WHERE stage IS NOT NULL WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq)) SELECT job_id, stage, CAST(sum(coalesce(epoch(until) - epoch(ts), 0)) AS BIGINT) AS seconds, CAST(count(*) FILTER (last IS NULL OR last <> stage) AS BIGINT) AS visits FROM x GROUP BY 1, 2")
def stage_durations(s, d):
    return logs.stage_durations(logs.parse(derived.log_lines(s, d)))


@_add(f"WITH {LOGS} SELECT level, CAST(count(*) AS BIGINT) AS n FROM raw GROUP BY level")
def level_counts(s, d):
    return logs.level_counts(logs.parse(derived.log_lines(s, d)))


@_add(f"WITH {LOGS} SELECT job_id, CAST(epoch(max(ts)) AS BIGINT) AS last_at, CAST(count(*) AS BIGINT) AS lines FROM raw GROUP BY job_id ORDER BY max(ts) DESC, job_id LIMIT 40")
def newest_40(s, d):
    return logs.newest(logs.parse(derived.log_lines(s, d))).select("job_id", F.unix_timestamp("last_ts").alias("last_at"), "lines")


SIDE = ", sd AS (SELECT id, id % 2 AS x FROM nodes), tot AS (SELECT sum(abs(w)) AS scale FROM e), wt AS (SELECT sum(c) AS total FROM nodes)"
MOVES = ", co AS (SELECT s.u AS id, b.p, sum(w) AS w FROM sym s JOIN np b ON s.v = b.id GROUP BY 1, 2), mv AS (SELECT co.id, np.p AS source, co.p AS target, co.w - coalesce(h.w, 0) AS gain FROM co JOIN np ON co.id = np.id AND co.p <> np.p LEFT JOIN co h ON h.id = np.id AND h.p = np.p QUALIFY row_number() OVER (PARTITION BY co.id ORDER BY co.w - coalesce(h.w, 0) DESC, co.p) = 1), gd AS (SELECT * FROM mv WHERE gain > 0)"


@_add(f"WITH {KM}, h AS (SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT CAST(p_partkey AS BIGINT) + (SELECT n FROM meta) FROM part WHERE p_partkey % 10 <> 3 AND p_partkey % 97 = 0) SELECT x.id, 'missing' AS problem FROM (SELECT unnest(range(0, (SELECT n FROM meta))) AS id) x WHERE x.id NOT IN (SELECT id FROM h) UNION ALL SELECT id, 'extra' FROM h WHERE id < 0 OR id >= (SELECT n FROM meta)")
def coverage_missing_extra(s, d):
    n = derived.size(s, d)
    return partition.coverage(derived.p_holes(s, d, n), n)


@_add(f"WITH {KM}{GRAPH}{SIDE}, q AS (SELECT a.x AS xa, b.x AS xb, 2 * (n1.c / total) * (n2.c / total) - 2 * coalesce(e.w, 0) / scale AS q FROM nodes n1 JOIN nodes n2 ON n1.id < n2.id JOIN sd a ON a.id = n1.id JOIN sd b ON b.id = n2.id LEFT JOIN e ON e.u = n1.id AND e.v = n2.id CROSS JOIN tot CROSS JOIN wt), li2 AS (SELECT sum(x * (coalesce(g.deg, 0) / scale + (c / total) * (c / total) - c / total)) AS l FROM nodes JOIN sd USING (id) LEFT JOIN (SELECT u AS id, sum(w) AS deg FROM sym GROUP BY u) g USING (id) CROSS JOIN tot CROSS JOIN wt) SELECT round(l + (SELECT sum(q * xa * xb) FROM q), 6) AS energy FROM li2")
def qubo_energy(s, d):
    e, n = _graph(s, d)
    return partition.bisection_energy(e, n, n.select("id", (F.col("id") % 2).alias("x"))).select(F.round("energy", 6).alias("energy"))


@_add(f"WITH {KM}{GRAPH}{SIDE}, dg AS (SELECT u AS id, sum(w) AS deg FROM sym GROUP BY u), x AS (SELECT id, c / total AS c, coalesce(deg, 0) / scale AS g FROM nodes LEFT JOIN dg USING (id) CROSS JOIN tot CROSS JOIN wt) SELECT id, round(CASE WHEN abs(h) < 1e-9 THEN 0 ELSE h END, 9) AS h FROM (SELECT id, -(g + c * (c - CAST(0.6 AS DOUBLE))) / 2 - (2 * c * (1 - c) - 2 * g) / 4 AS h FROM x)")
def ising_fields(s, d):
    return partition.ising_fields(*_graph(s, d), target=0.3)


@_add(f"WITH {KM}{GRAPH}{NODEPART}{MOVES} SELECT id, source, target, gain FROM gd WHERE id NOT IN (SELECT s.u FROM sym s JOIN gd a ON s.u = a.id JOIN gd b ON s.v = b.id WHERE b.gain > a.gain OR (b.gain = a.gain AND b.id > a.id))")
def independent_moves(s, d):
    e, n = map(materialise, _graph(s, d))
    return partition.independent_moves(e, _parts(n))


@_add(f"WITH {KM}{GRAPH}, cp AS (SELECT CAST(1.5 AS DOUBLE) * sum(c) / 250 AS cap FROM nodes) SELECT s.u, CAST(count(*) AS BIGINT) AS n FROM sym s JOIN nodes a ON s.u = a.id JOIN nodes b ON s.v = b.id, cp WHERE a.c + b.c <= cap GROUP BY s.u")
def capped_candidates(s, d):
    e, n = map(materialise, _graph(s, d))
    cap = graph.weight_cap(n, 250).first()["cap"]
    return graph.candidates(e, n, cap=cap).groupBy("u").agg(F.count(F.lit(1)).alias("n"))


@_add(f"WITH {KM}{PART} SELECT i, j, p AS colour FROM k JOIN brand ON k.i = brand.id")
def spy_colour_rows(s, d):
    return derived.k_part(s, d).join(derived.p_brand(s, d).select(F.col("id").alias("i"), F.col("p").alias("colour")), "i").select("i", "j", "colour")


@_add("SELECT coalesce(unit, 'unknown') AS unit, CAST(count(*) AS BIGINT) AS jobs, CAST(sum(event_id % 32) AS BIGINT) AS qubits, CAST(sum(greatest(0, event_id % 100 - 10)) AS BIGINT) AS runtime FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_type END AS unit FROM events) GROUP BY 1")
def usage_by_unit(s, d):
    return results.usage_by_unit(derived.usage(s, d))


@_add(f"WITH {KM}{PART}, a AS (UNPIVOT (SELECT CAST(n AS DOUBLE) AS n, CAST(nnz AS DOUBLE) AS nnz, CAST(bandwidth AS DOUBLE) AS bandwidth, avg_bandwidth FROM (SELECT {SHAPE} FROM k)) ON COLUMNS(*) INTO NAME name VALUE value), b AS (UNPIVOT (SELECT CAST(n AS DOUBLE) AS n, CAST(nnz AS DOUBLE) AS nnz, CAST(bandwidth AS DOUBLE) AS bandwidth, avg_bandwidth FROM (SELECT {SHAPE} FROM pm)) ON COLUMNS(*) INTO NAME name VALUE value) SELECT a.name, a.value AS a, b.value AS b, round(b.value - a.value, 6) AS difference, CASE WHEN abs(b.value - a.value) < 1e-6 THEN 'Equal' WHEN b.value < a.value THEN 'B' ELSE 'A' END AS winner FROM a JOIN b ON a.name = b.name")
def run_compare_ab(s, d):
    k, n = derived.k_part(s, d), derived.size(s, d)
    moved = partition.permute(k, partition.node_order(derived.p_brand(s, d)))
    out = results.compare(results.long_form(metrics.shape(k, n)), results.long_form(metrics.shape(moved, n)))
    return out.withColumn("difference", F.round("difference", 6))


@_add(f"WITH {KM}{PART}, pts AS (SELECT CAST(x AS BIGINT) * 5 AS hundredths, CAST(CASE WHEN x = 0 THEN 0 ELSE greatest(1, ceil(CAST(x AS DOUBLE) * CAST(5.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) * CAST((SELECT n FROM meta) AS DOUBLE))) END AS BIGINT) AS width FROM unnest(range(0, 100)) AS t(x)), h AS (SELECT abs(i - j) AS dist, count(*) AS c FROM k GROUP BY 1), h2 AS (SELECT abs(i - j) AS dist, count(*) AS c FROM pm GROUP BY 1), tt AS (SELECT count(*) AS nnz FROM k) SELECT hundredths, CASE WHEN hundredths = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(coalesce((SELECT sum(c) FROM h WHERE dist <= width), 0) AS DOUBLE) / nnz, 9) END AS original, CASE WHEN hundredths = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST(coalesce((SELECT sum(c) FROM h2 WHERE dist <= width), 0) AS DOUBLE) / nnz, 9) END AS by_brand FROM pts, tt")
def curve_pivot_by_method(s, d):
    k, n = derived.k_part(s, d), derived.size(s, d)
    moved = partition.permute(k, partition.node_order(derived.p_brand(s, d)))
    return results.curve_by_method({"original": metrics.band_curve(k, n), "by_brand": metrics.band_curve(moved, n)})


def coarsening_levels(s, d):
    return locality.levels(s, d)


def refined_cut(s, d):
    """Cut before and after refinement passes."""
    e, n = map(materialise, _graph(s, d))
    part = _parts(n)
    after = partition.refine(e, n, part, K, 20, passes=3)
    return partition.edge_cut(e, part).withColumnRenamed("cut", "before").join(partition.edge_cut(e, after).withColumnRenamed("cut", "after"))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()} | {f.__name__: f for f in (coarsening_levels, refined_cut)}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items()}
