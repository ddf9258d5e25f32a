"""Matrices, partitions and logs that Spark derives from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphband.session import table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lines of one order with large quantities."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select("l_orderkey", F.col("l_partkey").cast("long").alias("i"), F.col("l_quantity").cast("double").alias("q"))
    other = lines.select("l_orderkey", F.col("i").alias("j"), F.col("q").alias("r"))
    return lines.join(other, "l_orderkey")


def k_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stiffness-like matrix (i, j, v): parts that share orders, by product of quantities."""
    return _pairs(spark, sf_dir).groupBy("i", "j").agg(F.sum(F.col("q") * F.col("r")).alias("v"))


def m_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass-like matrix of the same shape: how often two parts share an order."""
    return _pairs(spark, sf_dir).groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("v"))


def size(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the square matrices."""
    return table(spark, sf_dir, "part").count()


def p_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition (id, p) of the rows by brand; brands are few and are numbered before the join."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_brand")
    brands = part.select("p_brand").distinct()
    numbered = brands.select("p_brand", (F.dense_rank().over(Window.orderBy("p_brand")) - 1).cast("long").alias("p"))
    return part.join(numbered, "p_brand").select("id", "p")


#: A message of each stage, in their order.
STAGE_MESSAGES = ("Converting matrices to graphs", "Coarsening Heavy Edge Matching", "Multilevel Partitioning Scheme using METIS", "Uncoarsening Kernighan-Lin", "Permuting matrices")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log lines (job_id, seq, value) of runs, one for each event: a time and a level in brackets and a stage's message; some are bare errors and warnings."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    level = F.when(F.col("value") > 90, "ERROR").when(F.col("value") > 75, "WARNING").when(i % 3 == 0, "VERBOSE").otherwise("INFO")
    message = F.element_at(F.array(*map(F.lit, STAGE_MESSAGES)), (F.pmod(F.expr("event_id div 7"), F.lit(5)) + 1).cast("int"))
    line = F.concat(F.lit("["), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" UTC "), level, F.lit("] "), message, F.lit(" #"), i.cast("string"))
    bare = F.when(i % 13 == 5, F.concat(F.lit("Error: step "), i.cast("string"))).when(i % 17 == 3, F.lit("run.py:7: UserWarning: slow")).when(i % 29 == 4, F.lit("Traceback (most recent call last):"))
    return e.select(F.col("user_id").cast("long").alias("job_id"), i.cast("long").alias("seq"), F.coalesce(bare, line).alias("value"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage records (job, unit, qubits, started, ended): each event is a job on the unit that its type names, every seventh on none."""
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts")
    unit = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return e.select(F.col("event_id").cast("long").alias("job"), unit.alias("unit"), (F.col("event_id") % 32).cast("long").alias("qubits"), start.alias("started"), (start + (F.col("event_id") % 100).cast("long") - 10).alias("ended"))


def p_holes(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """A partition that leaves out some rows and names others that do not exist."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") % 25).cast("long").alias("p"))
    some = part.where("id % 10 <> 3")
    return some.unionAll(some.where("id % 97 = 0").select((F.col("id") + n).alias("id"), "p"))
