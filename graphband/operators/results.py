"""Tables over runs: usage by unit, comparison of runs, pivoted curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphband.operators.graph import ranked
from graphband.session import materialise


def usage_by_unit(usage: DataFrame) -> DataFrame:
    """(unit, jobs, qubits, runtime): a job without a unit counts as unknown, one that ends before it starts as 0 seconds."""
    seconds = F.greatest(F.lit(0), F.coalesce(F.col("ended") - F.col("started"), F.lit(0)))
    return usage.groupBy(F.coalesce("unit", F.lit("unknown")).alias("unit")).agg(F.count(F.lit(1)).alias("jobs"), F.sum("qubits").alias("qubits"), F.sum(seconds).alias("runtime"))


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(name, a, b, difference, winner) of two runs' figures (name, value), of which the smaller is better; absent ones are kept."""
    both = a.select("name", F.col("value").alias("a")).join(b.select("name", F.col("value").alias("b")), "name", "full")
    d = F.col("b") - F.col("a")
    winner = F.when(d.isNull(), "N/A").when(F.abs(d) < tolerance, "Equal").when(d < 0, "B").otherwise("A")
    return both.select("name", "a", "b", d.alias("difference"), winner.alias("winner"))


def long_form(figures: DataFrame) -> DataFrame:
    """(name, value) of a frame with one row of numbers."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in figures.columns])
    return figures.select(F.inline(pairs))


def curve_by_method(curves: dict[str, DataFrame]) -> DataFrame:
    """One column of fractions for each method beside hundredths; 0 at 0 %."""
    out = None
    for name, curve in curves.items():
        one = curve.select("hundredths", F.when(F.col("hundredths") == 0, 0.0).otherwise(F.col("fraction")).alias(name))
        out = one if out is None else out.join(one, "hundredths", "full")
    return out


#: Variants of a figure, in the order of columns.
VARIANTS = ("original", "permuted")


def wide(metrics: DataFrame, names: tuple[str, ...], variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """(run_id, matrix, <name>_<variant>): one row for each run's matrix of long figures (run_id, matrix, variant, metric, value)."""
    cell = lambda m, v: F.max(F.when((F.col("metric") == m) & (F.col("variant") == v), F.col("value"))).alias(f"{key(m)}_{v}")
    return metrics.groupBy("run_id", "matrix").agg(*[cell(m, v) for m in names for v in variants])


def key(metric: str) -> str:
    """``frac_within_0.1%`` as a column's name: ``frac_0_1pct``."""
    return metric.replace("frac_within_", "frac_").replace(".", "_").replace("%", "pct")


def kpi_summary(metrics: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Key figures of each run's matrix: bandwidth and n * bandwidth ** 2 with their reductions in percent, shares within bands; null where the base is missing or 0."""
    w = wide(metrics, ("n", "nnz", "bandwidth", "avg_bandwidth", *[f"frac_within_{b}%" for b in bands]))
    n = F.coalesce("n_original", "n_permuted")
    b0, b1 = F.col("bandwidth_original"), F.col("bandwidth_permuted")
    nb2 = lambda b: F.when(b0.isNotNull() & b1.isNotNull(), n * b * b)
    less = lambda a, b: F.when(a > 0, F.round(100.0 * (a - b) / a, 6))
    w = w.withColumn("n", n).withColumn("nb2_original", nb2(b0)).withColumn("nb2_permuted", nb2(b1))
    w = w.withColumn("bandwidth_reduction_pct", less(b0, b1)).withColumn("nb2_reduction_pct", less(F.col("nb2_original"), F.col("nb2_permuted")))
    return w.drop("n_original", "n_permuted")


def curve_series(metrics: DataFrame, strict: bool = False) -> DataFrame:
    """(run_id, matrix, percent, original, permuted): shares on either side, 0 where a side is missing; ``strict`` keeps points with both."""
    x = metrics.where("metric LIKE 'frac_within_%' AND metric LIKE '%\\%'")
    x = x.withColumn("percent", F.regexp_extract("metric", r"([0-9.]+)%$", 1).cast("double"))
    side = lambda v: F.max(F.when(F.col("variant") == v, F.col("value")))
    found = x.groupBy("run_id", "matrix", "percent").agg(*[side(v).alias(v) for v in VARIANTS])
    return found.dropna(subset=VARIANTS) if strict else found.fillna(0.0, subset=VARIANTS)


def strict_curves(metrics: DataFrame) -> DataFrame:
    """As ``curve_series``; a point that lacks a side, or no point at all, is an error."""
    x = curve_series(metrics.where("value is not null"), True)
    points = metrics.where("metric LIKE 'frac_within_%' AND metric LIKE '%\\%'").select("run_id", "matrix", F.regexp_extract("metric", r"([0-9.]+)%$", 1).cast("double").alias("percent")).distinct()
    missing = points.join(x, ["run_id", "matrix", "percent"], "left_anti")
    first = missing.orderBy("run_id", "matrix", "percent").limit(3).collect()
    if first or points.isEmpty():
        raise ValueError(f"no values on both sides: {[tuple(r) for r in first] or 'no points'}")
    return x


def comparison_rows(cases: DataFrame, kpis: DataFrame) -> DataFrame:
    """case_key, status, run_id, two reductions in percent, error: a row for each case, also for those that failed or left nothing."""
    k = kpis.where("matrix = 'K'").select("run_id", "bandwidth_reduction_pct", "nb2_reduction_pct")
    error = F.when(F.col("status") == "failed", F.coalesce("error_type", F.lit("failed"))).when((F.col("status") == "completed") & F.col("bandwidth_reduction_pct").isNull(), "no result")
    return cases.select("case_key", "status", "run_id", "error_type").join(k, "run_id", "left").select("case_key", "status", "run_id", "bandwidth_reduction_pct", "nb2_reduction_pct", error.alias("error"))


def ordered_unique(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, rank): different values in the order in which ``place`` first has them."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("first"))
    return ranked(first, ["first", key], "rank").select(key, "rank")


def batch_summary(cases: DataFrame, metrics: DataFrame, bands: tuple[str, ...], matrices: tuple[str, ...] = ("K", "M")) -> DataFrame:
    """All cases, with the figures of those that left a result."""
    names = ("bandwidth", "avg_bandwidth", "nnz", *[f"frac_within_{b}%" for b in bands])
    cell = lambda x, m, v, a: F.max(F.when((F.col("matrix") == x) & (F.col("metric") == m) & (F.col("variant") == v), F.col("value"))).alias(a)
    cells = [cell(x, m, v, f"{x}_{key(m)}_{v}") for x in matrices for m in names for v in VARIANTS]
    cells += [cell(x, m, "check", f"{x}_permutation_{m}") for x in matrices for m in ("mismatches", "max_abs_err")]
    figures = metrics.groupBy("run_id").agg(*cells).withColumn("result_dir", F.concat(F.lit("run_"), F.col("run_id").cast("string"))).drop("run_id")
    return cases.join(figures, "result_dir", "left")


def status_counts(cases: DataFrame) -> DataFrame:
    """A row for each batch: cases by status, geometries, newest start."""
    count = lambda s: F.count_if(F.col("status") == s)
    return cases.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_cases"), count("completed").alias("completed_cases"), count("failed").alias("failed_cases"), count("running").alias("running_cases"),
        F.array_join(F.sort_array(F.collect_set("geometry")), ",").alias("geometries"), F.max("started").alias("newest"), F.max(F.col("status") == "failed").alias("any_failed"),
    )


def completed(cases: DataFrame, geometry: str | None = None) -> DataFrame:
    """Finished cases that left a result; of one geometry by its name or by the case key's start."""
    out = cases.where("status = 'completed' AND result_dir <> ''")
    return out if geometry is None else out.where((F.col("geometry") == geometry) | F.startswith("case_key", F.lit(f"{geometry}__")))


def runs_listing(cases: DataFrame, kpis: DataFrame) -> DataFrame:
    """A row for each geometry: runs, latest run (by start, then id) and its key figures, null where it left none."""
    latest = cases.groupBy("geometry").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.max(F.struct("started", "run_id", "status")).alias("x"))
    latest = latest.select("geometry", "runs", "completed", F.col("x.run_id").alias("run_id"), F.col("x.status").alias("latest_status"))
    return latest.join(kpis.where("matrix = 'K'").select("run_id", "bandwidth_original", "bandwidth_permuted", "bandwidth_reduction_pct"), "run_id", "left")


def _curves_of(metrics: DataFrame, first: DataFrame) -> DataFrame:
    """``curve_series`` of the runs in ``first`` (run_id, more), with its columns: other runs' figures are dropped before they are grouped."""
    first = materialise(first)
    return curve_series(metrics.join(first.select("run_id").distinct(), "run_id", "left_semi")).join(first, "run_id")


def analysis_curves(cases: DataFrame, metrics: DataFrame, algorithms: tuple[str, ...]) -> DataFrame:
    """(geometry, matrix, size, percent, original, one column for each algorithm): shares of the first finished case of each; 0 at 0 %."""
    done = completed(cases)
    first = done.groupBy("geometry", "size", "algorithm").agg(F.min("run_id").alias("run_id"))
    shown = _curves_of(metrics, first)
    by = ["geometry", "matrix", "size", "percent"]
    cell = lambda a: F.max(F.when(F.col("algorithm") == a, F.col("permuted"))).alias(a)
    out = shown.groupBy(*by).agg(F.min_by("original", "run_id").alias("original"), *map(cell, algorithms))
    zero = out.select("geometry", "matrix", "size").distinct().select("*", F.lit(0.0).alias("percent"), F.lit(0.0).alias("original"), *[F.lit(0.0).alias(a) for a in algorithms])
    return out.unionByName(zero)


def overlay(cases: DataFrame, metrics: DataFrame, a: str, b: str, matrix: str = "K") -> DataFrame:
    """(geometry, size, percent, a, b): two algorithms' curves where both have a finished case of one geometry and size."""
    first = completed(cases).where(F.col("algorithm").isin(a, b)).groupBy("geometry", "size", "algorithm").agg(F.min("run_id").alias("run_id"))
    x = _curves_of(metrics.where(F.col("matrix") == matrix), first)
    one = lambda v, to: x.where(F.col("algorithm") == v).select("geometry", "size", "percent", F.col("permuted").alias(to))
    return one(a, "a").join(one(b, "b"), ["geometry", "size", "percent"])


def report_rows(cases: DataFrame, kpis: DataFrame, sizes: tuple[str, ...]) -> DataFrame:
    """Lines of a printed table, in order: geometry, size, algorithm, and figures as text; N/A where there is none."""
    text = lambda c, f, kind="double": F.coalesce(F.format_string(f, F.col(c).cast(kind)), F.lit("N/A"))
    shown = lambda c, x: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(x)
    x = completed(cases).join(kpis.where("matrix = 'K'"), "run_id", "left")
    rank = F.array_position(F.array(*map(F.lit, sizes)), F.col("size"))
    cells = [("bandwidth_original", "%d", "long"), ("bandwidth_permuted", "%d", "long"), ("bandwidth_reduction_pct", "%.2f", "double"), ("frac_0_4pct_permuted", "%.4f", "double")]
    return x.select("geometry", rank.cast("long").alias("size_rank"), "algorithm", "run_id", *[shown(c, text(c, f, k)).alias(c) for c, f, k in cells])


def differences(a: DataFrame, b: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(doc, label, a, b) where two sets of flat documents (doc, columns) differ; absent ones are null."""
    both = a.alias("a").join(b.alias("b"), F.col("a.doc") == F.col("b.doc"), "full")
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"a.{c}").alias("a"), F.col(f"b.{c}").alias("b")) for c in columns])
    return both.select(F.coalesce("a.doc", "b.doc").alias("doc"), F.inline(rows)).where("NOT a <=> b")


def with_fallback(wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """Each wanted (geometry, algorithm, size) with the template run that fits best: exact, same geometry and algorithm, same geometry, any."""
    first = lambda *by: templates.groupBy(*by).agg(F.min("run_id").alias("r"))
    out = wanted
    for i, by in enumerate((("geometry", "algorithm", "size"), ("geometry", "algorithm"), ("geometry",))):
        out = out.join(first(*by).withColumnRenamed("r", f"r{i}"), list(by), "left")
    out = out.join(templates.agg(F.min("run_id").alias("r3")))  # one row
    level = F.when(F.col("r0").isNotNull(), "exact").when(F.col("r1").isNotNull(), "algorithm").when(F.col("r2").isNotNull(), "geometry").otherwise("any")
    return out.select(*wanted.columns, F.coalesce("r0", "r1", "r2", "r3").alias("run_id"), level.alias("match"))


def latest_state(transitions: DataFrame) -> DataFrame:
    """(case_id, state, at, transitions, failures): where each case stands after all its transitions."""
    return transitions.groupBy("case_id").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("at").alias("at"), F.count(F.lit(1)).alias("transitions"), F.count_if(F.col("state") == "failed").alias("failures"))


def probe_limits(attempts: DataFrame) -> DataFrame:
    """(unit, widest_ok, narrowest_failed, attempts)."""
    return attempts.groupBy("unit").agg(F.max(F.when(F.col("ok"), F.col("width"))).alias("widest_ok"), F.min(F.when(~F.col("ok"), F.col("width"))).alias("narrowest_failed"), F.count(F.lit(1)).alias("attempts"))


def newest_runs(cases: DataFrame, n: int = 3) -> DataFrame:
    """The n newest runs of each geometry, with their keys cut to 16 characters; Spark cuts each task's rows to n before it shuffles them."""
    newest = cases.withColumn("r", F.row_number().over(Window.partitionBy("geometry").orderBy(F.desc("started"), F.desc("run_id")))).where(F.col("r") <= n)
    short = F.when(F.length("case_key") > 16, F.concat(F.substring("case_key", 1, 13), F.lit("..."))).otherwise(F.col("case_key"))
    return newest.select("geometry", F.col("r").cast("long").alias("place"), "run_id", short.alias("label"))


def thinned(points: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """About ``most`` points of each curve, evenly spread, with its last."""
    w = Window.partitionBy(*by)
    x = points.withColumn("r", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return x.where((F.col("r") % step == 0) | (F.col("r") == F.col("n") - 1)).drop("r", "n")


#: Key figures of a comparison, and whether the larger one wins.
COMPARED = {"bandwidth_permuted": False, "avg_bandwidth_permuted": False, "bandwidth_reduction_pct": True, "nb2_reduction_pct": True, "frac_0_4pct_permuted": True}


def compare_runs(kpis: DataFrame, pairs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(a_run, b_run, matrix, kpi, a, b, difference, winner) of pairs of runs (a_run, b_run); N/A where a side has no figure."""
    rows = F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.lit(larger).alias("larger")) for k, larger in COMPARED.items()])
    x = kpis.select("run_id", "matrix", F.inline(rows))
    a = pairs.join(x.select(F.col("run_id").alias("a_run"), "matrix", "kpi", "larger", F.col("value").alias("a")), "a_run")
    both = a.join(x.select(F.col("run_id").alias("b_run"), "matrix", "kpi", F.col("value").alias("b")), ["b_run", "matrix", "kpi"])
    d = F.col("b") - F.col("a")
    winner = F.when(d.isNull(), "N/A").when(F.abs(d) < tolerance, "Equal").when((d > 0) == F.col("larger"), "B").otherwise("A")
    return both.select("a_run", "b_run", "matrix", "kpi", "a", "b", F.round(d, 6).alias("difference"), winner.alias("winner"))


def usage_of_resources(jobs: DataFrame, unit: str | None = None) -> DataFrame:
    """(unit, jobs, qubits, runs, runtime), most jobs first: of jobs (job, started, ended, resources of unit, qubits, runs).

    A job without resources counts as unknown; with several, its runtime
    counts for each.  ``unit`` keeps jobs that name it, whatever its case.
    """
    if unit is not None:
        jobs = jobs.where(F.exists("resources", lambda r: F.lower(r["unit"]).contains(unit.lower())))
    seconds = F.greatest(F.lit(0), F.coalesce(F.col("ended") - F.col("started"), F.lit(0)))
    x = jobs.select(seconds.alias("s"), F.explode_outer("resources").alias("r"))
    x = x.groupBy(F.coalesce("r.unit", F.lit("unknown")).alias("unit")).agg(F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("r.qubits"), F.lit(0)).alias("qubits"), F.coalesce(F.sum("r.runs"), F.lit(0)).alias("runs"), F.sum("s").alias("runtime"))
    return x.orderBy(F.desc("jobs"), "unit")


def case_row(cases: DataFrame, case_key: str) -> DataFrame:
    """The cases of one key; an unknown key is an error that names some known ones."""
    found = cases.where(F.col("case_key") == case_key)
    if found.isEmpty():
        known = [r[0] for r in cases.select("case_key").distinct().orderBy("case_key").limit(20).collect()]
        raise ValueError(f"no case {case_key!r}; known are {', '.join(known)}")
    return found


def scientific_rows(cases: DataFrame, kpis: DataFrame) -> DataFrame:
    """Lines of a printed table of n * bandwidth ** 2: mantissas with two digits, and how many entries were lost."""
    x = completed(cases).join(kpis.where("matrix = 'K'"), "run_id")

    def text(c: str) -> Column:
        power = F.floor(F.log10(c)).cast("int")
        digits = F.floor(F.col(c) / F.pow(F.lit(10.0), power - 2) + 0.5)  # of whole numbers: halves go up
        return F.format_string("%.2fe%d", digits / 100.0, power)

    return x.select("case_key", "run_id", text("nb2_original").alias("nb2_original"), text("nb2_permuted").alias("nb2_permuted"), (F.col("nnz_original") - F.col("nnz_permuted")).cast("long").alias("lost"))
