"""How near a matrix's entries stand to the diagonal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphband.functions.bands import band_label, band_width, percents
from graphband.session import materialise


def shape(entries: DataFrame, n: int) -> DataFrame:
    """n, nnz, bandwidth, avg_bandwidth; zeros of a matrix without entries."""
    d = F.abs(F.col("i") - F.col("j"))
    avg = F.coalesce(F.sum(d).cast("double") / F.count(F.lit(1)), F.lit(0.0))
    return entries.agg(F.lit(n).cast("long").alias("n"), F.count(F.lit(1)).alias("nnz"), F.coalesce(F.max(d), F.lit(0)).alias("bandwidth"), F.round(avg, 6).alias("avg_bandwidth"))


def fixed_band(entries: DataFrame, width: int = 200) -> DataFrame:
    """How many and which share of the entries stand within ``width``; share 1 without entries."""
    inside = F.count_if(F.abs(F.col("i") - F.col("j")) <= width)
    n = F.count(F.lit(1))
    return entries.agg(inside.alias("within"), F.when(n > 0, F.round(inside.cast("double") / n, 9)).otherwise(1.0).alias("fraction"))


def by_distance(entries: DataFrame) -> DataFrame:
    """(d, k): how many entries stand at each distance."""
    return entries.groupBy(F.abs(F.col("i") - F.col("j")).alias("d")).agg(F.count(F.lit(1)).alias("k"))


def band_curve(entries: DataFrame, n: int) -> DataFrame:
    """(percent, width, within, fraction) at 100 widths.

    Entries are first counted by distance, then by the least width that holds
    them, so that only a hundred rows are summed up in order.
    """
    return _curve(by_distance(entries), n)


def _curve(far: DataFrame, n: int) -> DataFrame:
    """``band_curve`` of the entries counted in (d, k)."""
    points = far.sparkSession.range(100).select((F.col("id") * 5).alias("hundredths"), band_width(percents("id"), n).alias("width"))
    widths = F.array_sort(F.array_distinct(F.collect_list("width")))
    all_widths = points.agg(widths.alias("widths"))
    first = F.array_min(F.filter("widths", lambda w: w >= F.col("d")))
    held = far.join(F.broadcast(all_widths)).groupBy(first.alias("width")).agg(F.sum("k").alias("k"))  # one row of at most 100 numbers
    total = far.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("nnz"))
    steps = points.select("width").distinct().join(held, "width", "left")
    run = steps.select("width", F.coalesce(F.sum("k").over(Window.orderBy("width")), F.lit(0)).alias("within"))
    share = F.when(F.col("nnz") > 0, F.round(F.col("within").cast("double") / F.col("nnz"), 9)).otherwise(1.0)
    return points.join(run, "width").join(F.broadcast(total)).select("hundredths", "width", "within", share.alias("fraction"))


def kpis(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reductions in percent of bandwidth and of n * bandwidth ** 2; null where there was none."""
    a = before.select("n", F.col("bandwidth").alias("b0"), F.col("avg_bandwidth").alias("a0"))
    b = after.select(F.col("bandwidth").alias("b1"), F.col("avg_bandwidth").alias("a1"))
    x = a.join(b)  # one row each
    ratio = F.col("b1").cast("double") / F.nullif(F.col("b0"), F.lit(0)).cast("double")
    return x.select(
        F.col("b0").alias("bandwidth_original"), F.col("b1").alias("bandwidth_permuted"), F.col("a0").alias("avg_original"), F.col("a1").alias("avg_permuted"),
        F.round((1 - ratio) * 100, 6).alias("bandwidth_reduction"), F.round((1 - ratio * ratio) * 100, 6).alias("nb2_reduction"),
    )


def permutation_check(entries: DataFrame, permuted: DataFrame, order: DataFrame, n: int, samples: int, seed: int = 0, tolerance: float = 0.0) -> DataFrame:
    """(samples, mismatches, max_abs_err, sum_sampled) over positions drawn with replacement, absent entries read as 0.

    Positions follow from whole-number arithmetic that every engine shares; max_abs_err is over mismatches.
    """
    i = (F.col("id") * 7919 + seed * 31 + F.expr("id div 7")) % n
    j = (F.col("id") * 104_729 + seed * 17 + F.expr("id * id") % 1009) % n
    drawn = entries.sparkSession.range(samples).select("id", i.alias("i"), j.alias("j"))
    at = drawn.join(order.select(F.col("old").alias("i"), F.col("new").alias("ni")), "i").join(order.select(F.col("old").alias("j"), F.col("new").alias("nj")), "j")
    # The matrices stay where they are: the positions, few in number, go to them.
    there = permuted.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("v").alias("pv"))
    here, there = entries.join(F.broadcast(drawn), ["i", "j"], "left_semi"), there.join(F.broadcast(at), ["ni", "nj"], "left_semi")
    at = at.join(here, ["i", "j"], "left").join(there, ["ni", "nj"], "left")
    v = F.coalesce("v", F.lit(0.0))
    err = F.abs(v - F.coalesce("pv", F.lit(0.0)))
    bad = err > tolerance
    return at.agg(F.count(F.lit(1)).alias("samples"), F.count_if(bad).alias("mismatches"), F.coalesce(F.max(F.when(bad, err)), F.lit(0.0)).alias("max_abs_err"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum_sampled"))


def long_figures(entries: DataFrame, n: int) -> DataFrame:
    """(metric, value): n, nnz, bandwidth, average, the 200-wide band, and the shares of 100 widths by their labels; as ``shape``, ``fixed_band`` and ``band_curve`` have them.

    Entries are counted by distance once for all figures.
    """
    far = materialise(by_distance(entries))
    nnz, d = F.coalesce(F.sum("k"), F.lit(0)), F.col("d")
    inside = F.coalesce(F.sum(F.when(d <= 200, F.col("k"))), F.lit(0))
    avg = F.coalesce(F.sum(d * F.col("k")).cast("double") / F.sum("k"), F.lit(0.0))
    share = F.when(nnz > 0, F.round(inside.cast("double") / nnz, 9)).otherwise(1.0)
    one = far.agg(F.lit(n).cast("long").alias("n"), nnz.alias("nnz"), F.coalesce(F.max("d"), F.lit(0)).alias("bandwidth"), F.round(avg, 6).alias("avg_bandwidth"), inside.alias("count_within_200"), share.alias("frac_within_200"))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])
    label = F.concat(F.lit("frac_within_"), band_label(F.col("hundredths") / F.lit(100.0)))
    return one.select(F.inline(rows)).unionAll(_curve(far, n).select(label, "fraction"))


#: Sampled positions of the permutation check, by matrix.
SAMPLES = {"K": 20_000, "M": 5_000}


def bundle(matrices: dict[str, tuple[DataFrame, DataFrame]], order: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(matrix, variant, metric, value) of matrices (original, permuted), with each permutation check as the variant ``check``."""
    out = None
    for name, (a, b) in matrices.items():
        rows = [long_figures(x, n).select(F.lit(name).alias("matrix"), F.lit(v).alias("variant"), "metric", "value") for v, x in (("original", a), ("permuted", b))]
        check = permutation_check(a, b, order, n, SAMPLES.get(name, 5_000), seed)
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in check.columns])
        rows.append(check.select(F.lit(name).alias("matrix"), F.lit("check").alias("variant"), F.inline(cells)))
        for r in rows:
            out = r if out is None else out.unionAll(r)
    return out


def warnings(figures: DataFrame) -> DataFrame:
    """(matrix, warning) where reordering widened the band or moved an entry wrongly."""
    wide = figures.where("metric IN ('bandwidth', 'mismatches')").groupBy("matrix").agg(*[F.max(F.when((F.col("variant") == v) & (F.col("metric") == m), F.col("value"))).alias(a) for v, m, a in (("original", "bandwidth", "b0"), ("permuted", "bandwidth", "b1"), ("check", "mismatches", "bad"))])
    found = F.array(F.when(F.col("b1") > F.col("b0"), "bandwidth grew"), F.when(F.col("bad") > 0, "entries differ"))
    return wide.select("matrix", F.explode(F.array_compact(found)).alias("warning"))
