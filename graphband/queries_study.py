"""Registered queries over studies, documents and run logs, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband import config, queries as base
from graphband.functions import guards, names
from graphband.operators import batch, documents, results
from graphband.session import materialise, shared_dir, table
from graphband.sources import derived, study
from graphband.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
ALGORITHMS = ("high", "low", "medium", "notspecified", "urgent")
BANDS = study.BANDS

#: Common table expressions, in DuckDB's SQL.
CASES = "cs AS (SELECT CAST(o_custkey % 20 AS BIGINT) AS batch_id, CAST(o_orderkey AS BIGINT) AS run_id, 'geo_' || CAST(o_orderkey % 6 AS VARCHAR) AS geometry, lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g')) AS algorithm, list_extract(['small', 'medium', 'big'], CAST((o_orderkey // 6) % 3 + 1 AS INTEGER)) AS size, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, CAST(epoch(o_orderdate) AS BIGINT) AS started, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 <> 0 THEN 'run_' || CAST(o_orderkey AS VARCHAR) END AS result_dir, CASE WHEN o_orderstatus = 'P' THEN 'ValueError' END AS error_type FROM orders), c AS (SELECT *, geometry || '__' || algorithm || '__' || size AS case_key FROM cs), done AS (SELECT * FROM c WHERE status = 'completed' AND result_dir <> '')"
SHARES = ", ".join(f"round(CAST(count(*) FILTER (q <= {10 * i}) AS DOUBLE) / count(*), 6) AS o{i}, round(CAST(count(*) FILTER (q <= {12 * i}) AS DOUBLE) / count(*), 6) AS x{i}" for i in range(1, 5))
FIGURES = f"li AS (SELECT CAST(l_orderkey AS BIGINT) AS run_id, CASE WHEN l_linestatus = 'O' THEN 'K' ELSE 'M' END AS matrix, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS tax FROM lineitem), mx AS (SELECT run_id, matrix, CAST(count(*) AS DOUBLE) AS cnt, sum(q) + count(*) AS b0, max(q) AS b1, round(sum(q) / count(*), 6) AS a0, round(max(q) / count(*), 6) AS a1, {SHARES}, CAST(count(*) FILTER (tax > CAST(0.07 AS DOUBLE)) AS DOUBLE) AS mism, coalesce(max(tax) FILTER (tax > CAST(0.07 AS DOUBLE)), 0) AS err FROM li GROUP BY ALL), mw AS (SELECT *, x1 AS p1, x2 AS p2, CASE WHEN cnt % 2 = 0 THEN x3 END AS p3, x4 AS p4 FROM mx)"
KPI = "kp AS (SELECT run_id, matrix, cnt + 100 AS n, cnt * 10 AS nnz_original, cnt * 10 AS nnz_permuted, b0 AS bandwidth_original, b1 AS bandwidth_permuted, a0 AS avg_bandwidth_original, a1 AS avg_bandwidth_permuted, CASE WHEN b0 > 0 THEN round(CAST(100 AS DOUBLE) * (b0 - b1) / b0, 6) END AS bandwidth_reduction_pct, (cnt + 100) * b0 * b0 AS nb2_original, (cnt + 100) * b1 * b1 AS nb2_permuted, CASE WHEN b0 > 0 THEN round(CAST(100 AS DOUBLE) * ((cnt + 100) * b0 * b0 - (cnt + 100) * b1 * b1) / ((cnt + 100) * b0 * b0), 6) END AS nb2_reduction_pct, " + ", ".join(f"o{i} AS frac_{b.replace('.', '_')}pct_original, p{i} AS frac_{b.replace('.', '_')}pct_permuted" for i, b in enumerate(BANDS, 1)) + " FROM mw)"
CURVE = "cu AS (" + " UNION ALL ".join(f"SELECT run_id, matrix, CAST({b} AS DOUBLE) AS percent, o{i} AS original, coalesce(p{i}, 0) AS permuted FROM mw" for i, b in enumerate(BANDS, 1)) + ")"
DOCS = (
    "d AS (SELECT doc, CAST(doc % 7 AS VARCHAR) AS dof_per_node, CAST(doc AS VARCHAR) AS seed, CAST(size * 10 AS VARCHAR) AS coarsen_inferior_limit, CASE WHEN doc % 5 <> 0 THEN CAST(size * 10 + doc % 100 - 20 AS VARCHAR) END AS coarsen_superior_limit, CASE WHEN doc % 31 <> 0 THEN CAST(doc % 40 AS VARCHAR) ELSE 'many' END AS max_levels, "
    "list_extract(['random', 'SORTED', 'modified', 'light', 'heavy'], CAST(doc % 5 + 1 AS INTEGER)) AS strategy, list_extract(['0.99', '0.5', '1.0', '1.5'], CAST(doc % 4 + 1 AS INTEGER)) AS coarsen_ratio, CASE WHEN doc % 3 = 0 THEN CAST(doc % 9 AS VARCHAR) END AS max_node_weight, list_extract(['levels', 'annealing', 'circuit'], CAST(doc % 3 + 1 AS INTEGER)) AS partitioning_strategy, CASE WHEN doc % 6 <> 5 THEN CAST(doc % 6 AS VARCHAR) END AS k_target, "
    "list_extract(['0.1', '2', '-1'], CAST(doc % 3 + 1 AS INTEGER)) AS balance_tolerance, CAST(doc % 60 AS VARCHAR) AS num_starts, CAST(doc % 25 AS VARCHAR) AS num_reads, CAST(doc % 13 AS VARCHAR) AS num_steps, CAST(doc % 21 AS VARCHAR) AS num_shots, list_extract(['true', 'no', 'maybe'], CAST(doc % 3 + 1 AS INTEGER)) AS simulated, list_extract(['cut', 'Cut_Balance', 'other'], CAST(doc // 3 % 3 + 1 AS INTEGER)) AS refine_objective, list_extract(['0', '0.5'], CAST(doc % 2 + 1 AS INTEGER)) AS refine_balance_lambda "
    "FROM (SELECT CAST(p_partkey AS BIGINT) AS doc, CAST(p_size AS BIGINT) AS size FROM part))"
)
LINES = "ev AS (SELECT CAST(user_id AS BIGINT) AS job_id, event_id AS i, CAST(floor(value * 10) AS BIGINT) AS v, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000000 + event_id AS k, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events), rl AS (SELECT *, CASE i % 6 WHEN 0 THEN 'Graph G_K with ' || (i + 10) || ' nodes and ' || (v + 1) || ' edges' WHEN 1 THEN 'Coarse graph has ' || v || ' nodes and ' || i || ' edges with ' || (i % 9) || ' levels' WHEN 2 THEN 'Partitioning on coarse graph produced ' || (i % 8 + 1) || ' parts' WHEN 3 THEN 'Results saved in runs/run_' || i WHEN 4 THEN 'Uncoarsening Kernighan-Lin' ELSE 'step ' || i END AS message FROM ev)"

_ALL: dict[str, tuple[Query, str]] = {}


def _add(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return keep


def _kpis(s: SparkSession, d: str) -> DataFrame:
    return results.kpi_summary(study.metrics(s, d), BANDS)


@_add(f"WITH {FIGURES}, {KPI} SELECT * FROM kp")
def kpi_summary(s, d):
    return _kpis(s, d)


@_add(f"WITH {FIGURES}, {CURVE} SELECT * FROM cu")
def curve_series(s, d):
    return results.curve_series(study.metrics(s, d))


SUMMARY = ", ".join(
    ", ".join([f"{x}.b0 AS {x}_bandwidth_original, {x}.b1 AS {x}_bandwidth_permuted, {x}.a0 AS {x}_avg_bandwidth_original, {x}.a1 AS {x}_avg_bandwidth_permuted, {x}.cnt * 10 AS {x}_nnz_original, {x}.cnt * 10 AS {x}_nnz_permuted, {x}.mism AS {x}_permutation_mismatches, {x}.err AS {x}_permutation_max_abs_err"] + [f"{x}.o{i} AS {x}_frac_{b.replace('.', '_')}pct_original, {x}.p{i} AS {x}_frac_{b.replace('.', '_')}pct_permuted" for i, b in enumerate(BANDS, 1)])
    for x in ("K", "M")
)


@_add(f"WITH {CASES}, {FIGURES} SELECT c.*, {SUMMARY} FROM c LEFT JOIN (SELECT * FROM mw WHERE matrix = 'K') K ON c.result_dir = 'run_' || K.run_id LEFT JOIN (SELECT * FROM mw WHERE matrix = 'M') M ON c.result_dir = 'run_' || M.run_id")
def batch_summary_join(s, d):
    return results.batch_summary(study.cases(s, d), study.metrics(s, d), BANDS)


@_add(f"WITH {CASES} SELECT batch_id, CAST(count(*) AS BIGINT) AS total_cases, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed_cases, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed_cases, CAST(count(*) FILTER (status = 'running') AS BIGINT) AS running_cases, string_agg(DISTINCT geometry, ',' ORDER BY geometry) AS geometries, max(started) AS newest, bool_or(status = 'failed') AS any_failed FROM c GROUP BY batch_id")
def batch_status_counts(s, d):
    return results.status_counts(study.cases(s, d))


@_add(f"WITH {CASES} SELECT run_id, case_key FROM done WHERE geometry = 'geo_1' OR starts_with(case_key, 'geo_1__')")
def completed_of_geometry(s, d):
    return results.completed(study.cases(s, d), "geo_1").select("run_id", "case_key")


@_add(f"WITH {CASES}, {FIGURES}, {KPI}, l AS (SELECT geometry, CAST(count(*) OVER w AS BIGINT) AS runs, CAST(count(*) FILTER (status = 'completed') OVER w AS BIGINT) AS completed, run_id, status AS latest_status FROM c WINDOW w AS (PARTITION BY geometry) QUALIFY row_number() OVER (PARTITION BY geometry ORDER BY started DESC, run_id DESC) = 1) SELECT l.*, bandwidth_original, bandwidth_permuted, bandwidth_reduction_pct FROM l LEFT JOIN kp ON kp.run_id = l.run_id AND matrix = 'K'")
def runs_listing(s, d):
    return results.runs_listing(study.cases(s, d), _kpis(s, d))


CELLS = ", ".join(f"max(permuted) FILTER (algorithm = '{a}') AS {a}" for a in ALGORITHMS)
ZEROS = ", ".join(f"CAST(0 AS DOUBLE) AS {a}" for a in ALGORITHMS)


@_add(f"WITH {CASES}, {FIGURES}, {CURVE}, f AS (SELECT geometry, size, algorithm, min(run_id) AS run_id FROM done GROUP BY ALL), x AS (SELECT * FROM cu JOIN f USING (run_id)), t AS (SELECT geometry, matrix, size, percent, arg_min(original, run_id) AS original, {CELLS} FROM x GROUP BY geometry, matrix, size, percent) SELECT * FROM t UNION ALL SELECT DISTINCT geometry, matrix, size, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), {ZEROS} FROM t")
def batch_analysis_curves(s, d):
    return results.analysis_curves(study.cases(s, d), study.metrics(s, d), ALGORITHMS)


@_add(f"WITH {CASES}, {FIGURES}, {CURVE}, f AS (SELECT geometry, size, algorithm, min(run_id) AS run_id FROM done GROUP BY ALL), x AS (SELECT * FROM cu JOIN f USING (run_id) WHERE matrix = 'K') SELECT a.geometry, a.size, a.percent, a.permuted AS a, b.permuted AS b FROM x a JOIN x b ON a.geometry = b.geometry AND a.size = b.size AND a.percent = b.percent WHERE a.algorithm = 'high' AND b.algorithm = 'low'")
def method_overlay(s, d):
    return results.overlay(study.cases(s, d), study.metrics(s, d), "high", "low")


@_add(f"WITH {CASES}, {FIGURES}, {KPI} SELECT geometry, CAST(CASE size WHEN 'small' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS size_rank, algorithm, done.run_id, coalesce(CAST(CAST(bandwidth_original AS BIGINT) AS VARCHAR), 'N/A') AS bandwidth_original, coalesce(CAST(CAST(bandwidth_permuted AS BIGINT) AS VARCHAR), 'N/A') AS bandwidth_permuted, CASE WHEN bandwidth_reduction_pct IS NULL THEN 'N/A' ELSE printf('%.2f', round(bandwidth_reduction_pct, 2)) END AS bandwidth_reduction_pct, CASE WHEN frac_0_4pct_permuted IS NULL THEN 'N/A' ELSE printf('%.4f', frac_0_4pct_permuted) END AS frac_0_4pct_permuted FROM done LEFT JOIN kp ON kp.run_id = done.run_id AND matrix = 'K'")
def ordered_report_rows(s, d):
    return results.report_rows(study.cases(s, d), _kpis(s, d).withColumn("bandwidth_reduction_pct", F.round("bandwidth_reduction_pct", 2)), study.SIZES)


DIFF = " UNION ALL ".join(f"SELECT x.doc, '{c}' AS label, x.{c} AS a, y.{c} AS b FROM x FULL JOIN y ON x.doc = y.doc WHERE x.{c} IS DISTINCT FROM y.{c}" for c in study.PARAMETERS)


@_add(f"WITH {DOCS}, x AS (SELECT * REPLACE (doc // 2 AS doc) FROM d WHERE doc % 2 = 0), y AS (SELECT * REPLACE (doc // 2 AS doc) FROM d WHERE doc % 2 = 1) {DIFF.replace('SELECT x.doc,', 'SELECT coalesce(x.doc, y.doc) AS doc,')}")
def config_diff(s, d):
    docs = study.parameters(s, d)
    half = lambda r: docs.where(f"doc % 2 = {r}").withColumn("doc", F.expr("doc div 2"))
    return results.differences(half(0), half(1), study.PARAMETERS)


@_add(f"WITH {CASES}, w AS (SELECT DISTINCT geometry, algorithm, size FROM c), t AS (SELECT * FROM done WHERE run_id % 1000 < 3 AND geometry <> 'geo_2'), t0 AS (SELECT geometry, algorithm, size, min(run_id) AS r FROM t GROUP BY ALL), t1 AS (SELECT geometry, algorithm, min(run_id) AS r FROM t GROUP BY ALL), t2 AS (SELECT geometry, min(run_id) AS r FROM t GROUP BY ALL) SELECT w.*, coalesce(t0.r, t1.r, t2.r, (SELECT min(run_id) FROM t)) AS run_id, CASE WHEN t0.r IS NOT NULL THEN 'exact' WHEN t1.r IS NOT NULL THEN 'algorithm' WHEN t2.r IS NOT NULL THEN 'geometry' ELSE 'any' END AS match FROM w LEFT JOIN t0 ON w.geometry = t0.geometry AND w.algorithm = t0.algorithm AND w.size = t0.size LEFT JOIN t1 ON w.geometry = t1.geometry AND w.algorithm = t1.algorithm LEFT JOIN t2 ON w.geometry = t2.geometry")
def priority_fallback_join(s, d):
    c = study.cases(s, d)
    return results.with_fallback(c.select("geometry", "algorithm", "size").distinct(), results.completed(c).where("run_id % 1000 < 3 AND geometry <> 'geo_2'"))


@_add("WITH e AS (SELECT CAST(user_id AS BIGINT) AS case_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS state FROM events) SELECT case_id, arg_max(state, seconds * 1000000000 + event_id) AS state, max(seconds) AS \"at\", CAST(count(*) AS BIGINT) AS transitions, CAST(count(*) FILTER (state = 'failed') AS BIGINT) AS failures FROM e GROUP BY case_id")
def manifest_latest_state(s, d):
    return results.latest_state(study.transitions(s, d))


@_add("WITH a AS (SELECT event_type AS unit, CAST(event_id % 40 + 1 AS BIGINT) AS width, value < 100 - 2 * (event_id % 40 + 1) AS ok FROM events) SELECT unit, max(width) FILTER (ok) AS widest_ok, min(width) FILTER (NOT ok) AS narrowest_failed, CAST(count(*) AS BIGINT) AS attempts FROM a GROUP BY unit")
def probe_limits(s, d):
    return results.probe_limits(study.probes(s, d))


@_add(f"WITH {CASES} SELECT geometry, CAST(row_number() OVER w AS BIGINT) AS place, run_id, CASE WHEN length(case_key) > 16 THEN left(case_key, 13) || '...' ELSE case_key END AS label FROM c WINDOW w AS (PARTITION BY geometry ORDER BY started DESC, run_id DESC) QUALIFY row_number() OVER w <= 3")
def newest_runs(s, d):
    return results.newest_runs(study.cases(s, d))


PRESETS = "a AS (SELECT p_brand AS algorithm, CAST(dense_rank() OVER (ORDER BY p_brand) AS BIGINT) AS a, size FROM (SELECT p_brand, list_extract(['small', 'medium', 'big'], CAST(p_size % 3 + 1 AS INTEGER)) AS size FROM part) GROUP BY p_brand, size HAVING count(*) % 3 > 0), z AS (SELECT list_extract(['small', 'medium', 'big'], CAST(p_size % 3 + 1 AS INTEGER)) AS size, CAST(p_size % 3 AS BIGINT) AS s, CAST(min(p_size) AS BIGINT) AS inferior, CAST(max(p_size) AS BIGINT) AS superior FROM part GROUP BY ALL)"


@_add(f"WITH {PRESETS} SELECT CAST(row_number() OVER (ORDER BY n_nationkey, algorithm, s) - 1 AS BIGINT) AS position, n_name || '__' || algorithm || '__' || size AS case_key, n_name AS geometry, algorithm, size, inferior, superior FROM a JOIN z USING (size) CROSS JOIN nation")
def case_product(s, d):
    p = table(s, d, "part").select("p_brand", study.pick(study.SIZES, F.col("p_size") % 3).alias("size"), (F.col("p_size") % 3).cast("long").alias("place"), F.col("p_size").cast("long").alias("n"))
    allowed = p.groupBy("p_brand", "size").agg(F.count(F.lit(1)).alias("k")).where("k % 3 > 0")
    presets = allowed.groupBy(F.col("p_brand").alias("algorithm")).agg(F.collect_list("size").alias("allowed")).withColumn("place", F.col("algorithm"))
    sizes = p.groupBy("size", "place").agg(F.min("n").alias("inferior"), F.max("n").alias("superior"))
    return batch.case_product(table(s, d, "nation").select(F.col("n_name").alias("geometry"), F.col("n_nationkey").alias("place")), presets, sizes)


#: Layers of defaults, from the base to the most specific.
LAYERS = [{"k_target": "2", "max_node_weight": "1e18", "coarsen_superior_limit": "2500"}, {"k_target": "4", "balance_tolerance": "0.02"}, {"coarsen_superior_limit": "175"}]
MERGED = ("seed", "k_target", "max_node_weight", "coarsen_superior_limit", "balance_tolerance")
MERGE = " UNION ALL ".join(f"SELECT doc, '{c}' AS name, coalesce({', '.join([c, *(repr(x[c]) for x in reversed(LAYERS) if c in x)])}) AS value FROM d" for c in MERGED)


@_add(f"WITH {DOCS} SELECT * FROM ({MERGE}) WHERE value IS NOT NULL")
def default_merge(s, d):
    return config.with_defaults(study.parameters(s, d), LAYERS, MERGED)


FLAWS = ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in config.FLAWS.items())


@_add(f"WITH {DOCS}, f AS (SELECT doc, list_filter([{FLAWS}], lambda x: x IS NOT NULL) AS f FROM d) SELECT doc, len(f) = 0 AS valid, CAST(len(f) AS BIGINT) AS n_flaws, array_to_string(f, ',') AS flaws FROM f")
def config_validation(s, d):
    return config.flaws(study.parameters(s, d))


WORK = "w AS (SELECT doc, partitioning_strategy, greatest(1, coalesce(try_cast(num_starts AS BIGINT), 1)) * greatest(1, coalesce(try_cast(k_target AS BIGINT), 2) - 1) AS base, greatest(1, coalesce(try_cast(num_reads AS BIGINT), 1)) AS r, greatest(1, coalesce(try_cast(num_steps AS BIGINT), 1)) + 1 AS st, greatest(1, coalesce(try_cast(num_shots AS BIGINT), 1)) AS sh, coalesce(lower(simulated) IN ('true', '1', 'yes', 'y'), true) AS local, try_cast(coarsen_inferior_limit AS BIGINT) AS low, try_cast(coarsen_superior_limit AS BIGINT) AS high FROM d)"


@_add(f"WITH {DOCS}, {WORK} SELECT doc, partitioning_strategy, CASE partitioning_strategy WHEN 'annealing' THEN base ELSE 0 END AS submissions, CASE partitioning_strategy WHEN 'annealing' THEN base * r ELSE 0 END AS reads, CASE partitioning_strategy WHEN 'circuit' THEN base * st ELSE 0 END AS jobs, CASE partitioning_strategy WHEN 'circuit' THEN base * st * sh ELSE 0 END AS shots, NOT local AND (partitioning_strategy = 'annealing' AND base > 50 OR partitioning_strategy = 'circuit' AND base * st > 100) AS warning FROM w")
def workload_estimates(s, d):
    return config.workload(study.parameters(s, d)).drop("infeasible")


@_add(f"WITH {DOCS}, {WORK} SELECT doc, coalesce(CASE WHEN partitioning_strategy = 'circuit' AND local THEN low > 18 OR coalesce(high > 20, false) WHEN partitioning_strategy = 'annealing' AND NOT local THEN coalesce(high, low) > 180 END, false) AS infeasible FROM w")
def feasibility_flags(s, d):
    return config.workload(study.parameters(s, d)).select("doc", "infeasible")


@_add("SELECT CAST(p_partkey AS BIGINT) AS id, nullif(regexp_replace(trim(p_name || ' ' || p_brand), '[^A-Za-z0-9_-]', '_', 'g'), '') AS name FROM part")
def sanitised_names(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), names.safe(F.concat("p_name", F.lit(" "), "p_brand")).alias("name"))


@_add("WITH x AS (SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN -p_retailprice WHEN 2 THEN NULL WHEN 3 THEN CAST('Infinity' AS DOUBLE) ELSE p_retailprice END AS w FROM part), y AS (SELECT id, w, coalesce(NOT isnan(w) AND NOT isinf(w), false) AS ok FROM x) SELECT id, CASE WHEN ok THEN greatest(CAST(0 AS DOUBLE), w) ELSE 1 END AS node_weight, CASE WHEN ok THEN w ELSE 1 END AS edge_weight, CASE WHEN ok THEN greatest(CAST(0 AS DOUBLE), w) ELSE 0 END AS balance_weight FROM y")
def weight_guards(s, d):
    k, price = F.col("p_partkey") % 5, F.col("p_retailprice")
    w = F.when(k == 0, F.lit(float("nan"))).when(k == 1, -price).when(k == 2, None).when(k == 3, F.lit(float("inf"))).otherwise(price)
    return table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), guards.node_weight(w).alias("node_weight"), guards.edge_weight(w).alias("edge_weight"), guards.balance_weight(w).alias("balance_weight"))


NUMBERS = {"initial_nodes": ("Graph G_K with (\\d+) nodes and (\\d+) edges", 1), "initial_edges": ("Graph G_K with (\\d+) nodes and (\\d+) edges", 2), "coarse_nodes": ("Coarse graph has (\\d+) nodes and (\\d+) edges with (\\d+) levels", 1), "coarse_edges": ("Coarse graph has (\\d+) nodes and (\\d+) edges with (\\d+) levels", 2), "coarsening_levels": ("Coarse graph has (\\d+) nodes and (\\d+) edges with (\\d+) levels", 3), "coarse_parts": ("Partitioning on coarse graph produced (\\d+) parts", 1)}
LAST = ", ".join(f"arg_max(try_cast(regexp_extract(message, '{rx}', {g}) AS BIGINT), k) FILTER (regexp_matches(message, '{rx}')) AS {name}" for name, (rx, g) in NUMBERS.items())


@_add(f"WITH {LINES} SELECT job_id, {LAST}, arg_max(regexp_extract(message, 'Results saved in (.+)$', 1), k) FILTER (regexp_matches(message, 'Results saved in (.+)$')) AS result_dir, arg_min(message, k) FILTER (level = 'ERROR') AS first_error FROM rl GROUP BY job_id")
def telemetry_extract(s, d):
    return logs.telemetry(logs.parse(study.run_lines(s, d)))


@_add(f"WITH {CASES}, {FIGURES}, {KPI} SELECT geometry || '__' || algorithm || '__' || size AS case_key, status, cs.run_id, kp.bandwidth_reduction_pct, kp.nb2_reduction_pct, CASE WHEN status = 'failed' THEN 'ValueError' WHEN status = 'completed' AND kp.bandwidth_reduction_pct IS NULL THEN 'no result' END AS error FROM cs LEFT JOIN kp ON kp.run_id = cs.run_id AND matrix = 'K'")
def comparison_rows(s, d):
    return results.comparison_rows(study.cases(s, d), _kpis(s, d))


NAMES = "['initialization', 'coarsening', 'partitioning', 'uncoarsening', 'permutation']"


@_add(f"WITH e AS (SELECT CAST(user_id AS BIGINT) AS job_id, event_id AS k, (event_id // 7) % 5 AS stage FROM events WHERE event_id % 13 <> 5 AND event_id % 17 <> 3 AND event_id % 29 <> 4), l AS (SELECT job_id, arg_max(stage, k) AS stage FROM e GROUP BY job_id) SELECT job_id, list_extract({NAMES}, CAST(stage + 1 AS INTEGER)) AS stage, CAST(least(95, (stage + 1) * 18) AS BIGINT) AS percent FROM l")
def stage_progress(s, d):
    return logs.progress(logs.parse(derived.log_lines(s, d)))


@_add(f"WITH {LINES}, x AS (SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) <= 40) SELECT job_id, right(string_agg(message, chr(10) ORDER BY i), 400) AS text FROM x GROUP BY job_id")
def log_tail(s, d):
    return logs.tail(logs.parse(study.run_lines(s, d)))


STATES = (
    f"WITH {LINES}, xl AS (SELECT rl.*, date_trunc('second', e.ts) AS ts, CASE WHEN i % 23 = 0 THEN CASE WHEN CAST(floor(e.value) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END END AS code FROM rl JOIN events e ON e.event_id = rl.i), "
    "en AS (SELECT job_id, min(i) AS ei, arg_min(code, i) AS code, arg_min(ts, i) AS ets FROM xl WHERE code IS NOT NULL GROUP BY job_id), "
    f"op AS (SELECT xl.job_id, xl.i, xl.ts, xl.level, xl.message, i AS k, ets, list_extract({NAMES}, CASE i % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 4 END) AS stage FROM xl LEFT JOIN en USING (job_id) WHERE xl.code IS NULL AND (ei IS NULL OR i <= ei)), "
    "sp AS (SELECT job_id, stage, i, greatest(0, epoch(coalesce(lead(ts) OVER (PARTITION BY job_id ORDER BY i), ets, ts))::BIGINT - epoch(ts)::BIGINT) AS s FROM op WHERE stage IS NOT NULL), "
    "st AS (SELECT job_id, arg_max(stage, i) AS stage, " + ", ".join(f"coalesce(CAST(sum(s) FILTER (stage = '{n}') AS BIGINT), 0) AS {n}" for n, _ in logs.STAGES) + " FROM sp GROUP BY job_id), "
    f"te AS (SELECT job_id, {LAST}, arg_max(regexp_extract(message, 'Results saved in (.+)$', 1), k) FILTER (regexp_matches(message, 'Results saved in (.+)$')) AS result_dir, arg_min(message, k) FILTER (level = 'ERROR') AS first_error FROM op GROUP BY job_id) "
    f"SELECT j.job_id, CASE WHEN en.code IS NULL THEN 'running' WHEN en.code = 0 THEN 'completed' ELSE 'failed' END AS status, st.stage, CAST(CASE WHEN en.code = 0 THEN 100 WHEN st.stage IS NULL THEN 0 ELSE least(95, list_position({NAMES}, st.stage) * 18) END AS BIGINT) AS percent, "
    + ", ".join(f"coalesce(st.{n}, 0) AS {n}" for n, _ in logs.STAGES) + ", " + ", ".join(f"coalesce({n}, -1) AS {n}" for n in NUMBERS) + ", result_dir, first_error FROM (SELECT DISTINCT job_id FROM xl) j LEFT JOIN en USING (job_id) LEFT JOIN st USING (job_id) LEFT JOIN te USING (job_id)"
)


@_add(STATES)
def job_states(s, d):
    return logs.job_states(logs.parse(study.ended_lines(s, d))).na.fill(-1)


TURN = 20_000  # lines in a file


@_add(STATES)
def job_states_streamed(s, d):
    """The same by way of a stream: lines arrive in four turns, one after another, and state is kept by job.

    A turn's lines are in as many files as their number asks for, each job's in one of them, so that no
    task writes or parses a whole turn and a job's turns come in their order however files fall into batches.
    """
    lines, folder = materialise(study.ended_lines(s, d)), shared_dir(s)
    told = lines.agg(F.max("seq"), F.count(F.lit(1))).first()
    top, files = told[0] or 0, 1 + told[1] // (4 * TURN)
    for k in range(4):
        lines.where(F.expr(f"seq * 4 div {top + 1} = {k}")).repartition(files, "job_id").write.mode("append").json(folder)
    return logs.replayed(s, folder, files).na.fill(-1)


@_add(f"WITH {base.LOGS}, nm AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id % 8 ORDER BY seq) - 1 AS BIGINT) AS n FROM raw) SELECT CAST(job_id % 8 AS BIGINT) AS job_id, n AS seq, coalesce(epoch(ts)::BIGINT, -1) AS at, level, message, stage FROM nm")
def raw_log_replay(s, d):
    """Logs written as raw text files, eight of them, and read back with line numbers."""
    folder = shared_dir(s)
    lines = derived.log_lines(s, d).withColumn("file", F.col("job_id") % 8)
    lines.repartition("file").sortWithinPartitions("file", "seq").select("file", "value").write.partitionBy("file").text(folder)
    raw = logs.read_files(s, folder).withColumn("job_id", F.regexp_extract("file", "file=([0-9]+)", 1).cast("long")).drop("file")
    return logs.parse(raw).select("job_id", "seq", F.coalesce(F.unix_timestamp("ts"), F.lit(-1)).alias("at"), "level", "message", "stage")


@_add("SELECT doc_id FROM documents WHERE source = 'src3' OR contains(lower(coalesce(lang, '')), 'fr') OR contains(lower(coalesce(text, '')), 'tion of')")
def text_search(s, d):
    """Rows of one category, or with a phrase in any field, whatever its case."""
    found = lambda c, q: F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return table(s, d, "documents").where((F.col("source") == "src3") | found("lang", "fr") | found("text", "tion of")).select("doc_id")


@_add(f"WITH {FIGURES}, {CURVE} SELECT * FROM cu WHERE percent <= CAST(0.5 AS DOUBLE)")
def curve_clipped(s, d):
    return results.curve_series(study.metrics(s, d)).where(F.col("percent") <= 0.5)


COMPARE = " UNION ALL ".join(f"SELECT a.run_id AS a_run, b.run_id AS b_run, a.matrix, '{k}' AS kpi, a.{k} AS a, b.{k} AS b, round(b.{k} - a.{k}, 6) AS difference, CASE WHEN b.{k} - a.{k} IS NULL THEN 'N/A' WHEN abs(b.{k} - a.{k}) < 1e-6 THEN 'Equal' WHEN (b.{k} - a.{k} > 0) = {'true' if larger else 'false'} THEN 'B' ELSE 'A' END AS winner FROM kp a JOIN kp b ON b.run_id = a.run_id + 1 AND a.matrix = b.matrix WHERE a.run_id % 2 = 0" for k, larger in results.COMPARED.items())


@_add(f"WITH {FIGURES}, {KPI} {COMPARE}")
def run_compare_kpis(s, d):
    kpis = _kpis(s, d)
    pairs = kpis.where("run_id % 2 = 0").select(F.col("run_id").alias("a_run"), (F.col("run_id") + 1).alias("b_run")).distinct()
    return results.compare_runs(kpis, pairs)


JOBS = "jb AS (SELECT event_id, greatest(0, CAST(event_id % 100 AS BIGINT) - 10) AS sec, event_type FROM events), rs AS (SELECT sec, event_type AS unit, event_id % 32 AS qubits, event_id % 5 AS runs FROM jb WHERE event_id % 7 <> 0 UNION ALL SELECT sec, 'Spare', event_id % 8, 1 FROM jb WHERE event_id % 7 <> 0 AND event_id % 3 = 0 UNION ALL SELECT sec, 'unknown', 0, 0 FROM jb WHERE event_id % 7 = 0)"


@_add(f"WITH {JOBS} SELECT unit, CAST(count(*) AS BIGINT) AS jobs, CAST(sum(qubits) AS BIGINT) AS qubits, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(sec) AS BIGINT) AS runtime FROM rs GROUP BY unit")
def usage_of_resources(s, d):
    return results.usage_of_resources(study.jobs(s, d))


SCIENCE = lambda c: f"printf('%.2f', floor({c} / pow(CAST(10 AS DOUBLE), floor(log10({c})) - 2) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE)) || 'e' || CAST(CAST(floor(log10({c})) AS INTEGER) AS VARCHAR)"


@_add(f"WITH {CASES}, {FIGURES}, {KPI} SELECT case_key, done.run_id, {SCIENCE('nb2_original')} AS nb2_original, {SCIENCE('nb2_permuted')} AS nb2_permuted, CAST(nnz_original - nnz_permuted AS BIGINT) AS lost FROM done JOIN kp ON kp.run_id = done.run_id AND matrix = 'K'")
def scientific_rows(s, d):
    return results.scientific_rows(study.cases(s, d), _kpis(s, d))


LEAVES = "SELECT d.doc, t.fullkey AS path, t.atom->>'$' AS value FROM {0} d, json_tree(CAST(d.json AS JSON)) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')"
DOCUMENTS = (
    "pd AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS s, p_brand, p_type FROM part), "
    "d1 AS (SELECT k AS doc, '{\"name\":\"' || p_brand || '\",\"matrix\":{\"size\":' || s || ',\"bands\":[' || (s % 7) || ',' || (s % 5) || ']},\"solver\":{\"kind\":\"' || p_type || '\",\"limits\":{\"passes\":' || (k % 9) || '}},\"tags\":[]}' AS json FROM pd), "
    "d2 AS (SELECT k AS doc, '{\"name\":\"' || p_brand || '\",\"matrix\":{\"size\":' || (CASE WHEN k % 3 = 0 THEN s + 1 ELSE s END) || ',\"bands\":[' || (s % 7) || ',' || (s % 4) || ',' || (k % 2) || ']},\"solver\":{\"kind\":\"' || p_type || '\",\"strict\":' || (CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END) || '},\"tags\":[]}' AS json FROM pd)"
)


@_add(f"WITH {DOCUMENTS}, l1 AS ({LEAVES.format('d1')}), l2 AS ({LEAVES.format('d2')}) SELECT coalesce(l1.doc, l2.doc) AS doc, coalesce(l1.path, l2.path) AS path, l1.value AS a, l2.value AS b, CASE WHEN l2.doc IS NULL THEN 'removed' WHEN l1.doc IS NULL THEN 'added' ELSE 'changed' END AS change FROM l1 FULL JOIN l2 ON l1.doc = l2.doc AND l1.path = l2.path WHERE l1.doc IS NULL OR l2.doc IS NULL OR l1.value IS DISTINCT FROM l2.value")
def document_paths_diff(s, d):
    """Two versions of nested documents, by path."""
    one, two = (documents.leaves(study.documents(s, d, v)) for v in (1, 2))
    return documents.differences(one, two)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items()}
