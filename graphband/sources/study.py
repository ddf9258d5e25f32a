"""Studies derived from the star-schema tables: batch cases, run figures, parameter documents, manifests, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband.session import table

SIZES = ("small", "medium", "big")
BANDS = ("0.1", "0.4", "0.7", "1.0")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each order: batch_id, case_key, geometry, algorithm, size, status, started, result_dir, run_id, error_type."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    c = o.select(
        (F.col("o_custkey") % 20).cast("long").alias("batch_id"), key.cast("long").alias("run_id"),
        F.concat(F.lit("geo_"), (key % 6).cast("string")).alias("geometry"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "")).alias("algorithm"),
        pick(SIZES, F.expr("o_orderkey div 6") % 3).alias("size"),
        F.when(done, "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running").alias("status"),
        F.unix_timestamp("o_orderdate").alias("started"),
        F.when(done & (key % 11 != 0), F.concat(F.lit("run_"), key.cast("string"))).alias("result_dir"),
        F.when(F.col("o_orderstatus") == "P", "ValueError").alias("error_type"),
    )
    return c.withColumn("case_key", F.concat_ws("__", "geometry", "algorithm", "size"))


LINES = 500_000  # lines whose figures one task sums up


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long figures (run_id, matrix, variant, metric, value) of each order's lines: two matrices, before and after, and a check.

    Lines are dealt to tasks before they are summed, to as many as their number
    asks for: a line is narrower than its run's sums, and a task's runs stay as many.
    """
    lines = table(spark, sf_dir, "lineitem")
    x = lines.select(F.col("l_orderkey").cast("long").alias("run_id"), F.when(F.col("l_linestatus") == "O", "K").otherwise("M").alias("matrix"), F.col("l_quantity").cast("double").alias("q"), F.col("l_tax").cast("double").alias("tax"))
    x = x.repartition(1 + lines.count() // LINES, "run_id", "matrix")
    n, q = F.count(F.lit(1)).cast("double"), F.col("q")
    figures = {("original", "n"): n + 100, ("permuted", "n"): n + 100, ("original", "nnz"): n * 10, ("permuted", "nnz"): n * 10}
    figures |= {("original", "bandwidth"): F.sum("q") + n, ("permuted", "bandwidth"): F.max("q"), ("original", "avg_bandwidth"): F.round(F.sum("q") / n, 6), ("permuted", "avg_bandwidth"): F.round(F.max("q") / n, 6)}
    for i, b in enumerate(BANDS, 1):
        figures[("original", f"frac_within_{b}%")] = F.round(F.count_if(q <= 10 * i) / n, 6)
        figures[("permuted", f"frac_within_{b}%")] = F.when(F.lit(b != "0.7") | (n % 2 == 0), F.round(F.count_if(q <= 12 * i) / n, 6))
    bad = F.col("tax") > 0.07
    figures |= {("check", "mismatches"): F.count_if(bad).cast("double"), ("check", "max_abs_err"): F.coalesce(F.max(F.when(bad, F.col("tax"))), F.lit(0.0))}
    wide = x.groupBy("run_id", "matrix").agg(*[v.alias(f"f{i}") for i, v in enumerate(figures.values())])
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(m).alias("metric"), F.col(f"f{i}").alias("value")) for i, (v, m) in enumerate(figures)])
    return wide.select("run_id", "matrix", F.inline(rows)).where("value is not null")


#: Columns of a flat parameter document, in the order of the rules.
PARAMETERS = ("dof_per_node", "seed", "coarsen_inferior_limit", "coarsen_superior_limit", "max_levels", "strategy", "coarsen_ratio", "max_node_weight", "partitioning_strategy", "k_target", "balance_tolerance", "num_starts", "num_reads", "num_steps", "num_shots", "simulated", "refine_objective", "refine_balance_lambda")


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat parameter document (doc, one text column for each of PARAMETERS) for each part; some are wrong on purpose."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc"), F.col("p_size").cast("long").alias("size"))
    k, size, text = F.col("doc"), F.col("size"), lambda c: c.cast("string")
    own = {
        "dof_per_node": text(k % 7), "seed": text(k), "coarsen_inferior_limit": text(size * 10),
        "coarsen_superior_limit": F.when(k % 5 != 0, text(size * 10 + k % 100 - 20)), "max_levels": F.when(k % 31 != 0, text(k % 40)).otherwise("many"),
        "strategy": pick(("random", "SORTED", "modified", "light", "heavy"), k % 5), "coarsen_ratio": pick(("0.99", "0.5", "1.0", "1.5"), k % 4),
        "max_node_weight": F.when(k % 3 == 0, text(k % 9)), "partitioning_strategy": pick(("levels", "annealing", "circuit"), k % 3),
        "k_target": F.when(k % 6 != 5, text(k % 6)), "balance_tolerance": pick(("0.1", "2", "-1"), k % 3), "num_starts": text(k % 60), "num_reads": text(k % 25),
        "num_steps": text(k % 13), "num_shots": text(k % 21), "simulated": pick(("true", "no", "maybe"), k % 3),
        "refine_objective": pick(("cut", "Cut_Balance", "other"), F.expr("doc div 3") % 3), "refine_balance_lambda": pick(("0", "0.5"), k % 2),
    }
    return p.select("doc", *[own[c].alias(c) for c in PARAMETERS])


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest transitions (case_id, seq, at, state) of cases: each event moves its user's case."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "queued").otherwise("running")
    return e.select(F.col("user_id").cast("long").alias("case_id"), F.col("event_id").cast("long").alias("seq"), F.unix_timestamp("ts").alias("at"), state.alias("state"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts (unit, width, ok) of growing widths on units: wider ones fail more often."""
    e = table(spark, sf_dir, "events")
    width = (F.col("event_id") % 40 + 1).cast("long")
    return e.select(F.col("event_type").alias("unit"), width.alias("width"), (F.col("value") < 100 - 2 * width).alias("ok"))


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines (job_id, seq, value) of whole runs, five messages in turn, some of them errors."""
    e = table(spark, sf_dir, "events")
    i, v = F.col("event_id"), F.floor(F.col("value") * 10).cast("long")
    text = (
        F.when(i % 6 == 0, F.format_string("Graph G_K with %d nodes and %d edges", i + 10, v + 1)).when(i % 6 == 1, F.format_string("Coarse graph has %d nodes and %d edges with %d levels", v, i, i % 9))
        .when(i % 6 == 2, F.format_string("Partitioning on coarse graph produced %d parts", i % 8 + 1)).when(i % 6 == 3, F.format_string("Results saved in runs/run_%d", i)).when(i % 6 == 4, F.lit("Uncoarsening Kernighan-Lin")).otherwise(F.format_string("step %d", i))
    )
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.lit("["), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" UTC "), level, F.lit("] "), text)
    return e.select(F.col("user_id").cast("long").alias("job_id"), i.cast("long").alias("seq"), line.alias("value"))


def ended_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_lines`` with ``exit_code``: of each job the first event whose number leaves 0 by 23 ends it, well or not; later lines go on nevertheless."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("seq"), F.floor("value").cast("int").alias("v"))
    code = F.when(F.col("seq") % 23 == 0, F.when(F.col("v") % 3 == 0, 1).otherwise(0))
    return run_lines(spark, sf_dir).join(e.select("seq", code.alias("exit_code")), "seq").select("job_id", "seq", "value", "exit_code")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs (job, started, ended, resources): each event is a job on no unit, one or two."""
    e = table(spark, sf_dir, "events")
    i, start = F.col("event_id"), F.unix_timestamp("ts")
    one = F.struct(F.col("event_type").alias("unit"), (i % 32).cast("long").alias("qubits"), (i % 5).cast("long").alias("runs"))
    two = F.struct(F.lit("Spare").alias("unit"), (i % 8).cast("long").alias("qubits"), F.lit(1).cast("long").alias("runs"))
    resources = F.when(i % 7 == 0, None).when(i % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    return e.select(i.cast("long").alias("job"), start.alias("started"), (start + (i % 100).cast("long") - 10).alias("ended"), resources.alias("resources"))


def documents(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Nested parameter documents (doc, json), one for each part; the second version changes, adds and leaves out some fields."""
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    first = F.format_string('{"name":"%s","matrix":{"size":%d,"bands":[%d,%d]},"solver":{"kind":"%s","limits":{"passes":%d}},"tags":[]}', "p_brand", size, size % 7, size % 5, "p_type", k % 9)
    second = F.format_string('{"name":"%s","matrix":{"size":%d,"bands":[%d,%d,%d]},"solver":{"kind":"%s","strict":%s},"tags":[]}', "p_brand", F.when(k % 3 == 0, size + 1).otherwise(size), size % 7, size % 4, k % 2, "p_type", F.when(k % 2 == 0, "true").otherwise("false"))
    return p.select(k.alias("doc"), (first if version == 1 else second).alias("json"))
