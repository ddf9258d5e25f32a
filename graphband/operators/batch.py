"""Batch studies: the product of geometries, algorithms and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.operators.graph import ranked


def case_product(geometries: DataFrame, presets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(position, case_key, geometry, algorithm, size, inferior, superior) of all allowed cases, in order of geometry, algorithm, size.

    ``geometries`` (geometry, place), ``presets`` (algorithm, place, allowed
    sizes), ``sizes`` (size, place, inferior, superior).  Geometries come as
    one row with their list, so that allowed cases alone are multiplied.
    """
    cases = presets.select("algorithm", F.col("place").alias("a"), F.explode("allowed").alias("size")).join(sizes.withColumnRenamed("place", "s"), "size")
    names = geometries.agg(F.sort_array(F.collect_list(F.struct("place", "geometry"))).alias("g"))
    rows = cases.join(F.broadcast(names)).select("*", F.explode("g").alias("x")).select(F.col("x.place").alias("g"), F.col("x.geometry").alias("geometry"), "a", "algorithm", "s", "size", "inferior", "superior")  # names is one row
    rows = rows.withColumn("case_key", F.concat_ws("__", "geometry", "algorithm", "size"))
    return ranked(rows, ["g", "a", "s"], "position").select("position", "case_key", "geometry", "algorithm", "size", "inferior", "superior")
