"""A stiffness and a mass matrix of a lattice of nodes with 26 neighbours each, numbered in a scattered order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband.operators.graph import ranked
from graphband.session import materialise, table


def shape(n: int) -> tuple[int, int, int]:
    """Sides of a lattice of at most n nodes, 5 and 4 in the shorter directions."""
    return max(1, n // 20), 5, 4


def numbers(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(cell, node): cells numbered by the rank of a scattering key, smaller cells first on ties."""
    n = nx * ny * nz
    cells = spark.range(n).select(F.col("id").alias("cell"), ((F.col("id") * 37 + F.expr(f"id div {nx}") * 13) % n).alias("key"))
    # The node with rank r in the scattered order is cell r's number.
    order = ranked(cells, ["key", "cell"], "place")
    return order.select(F.col("place").alias("cell"), F.col("cell").alias("node"))


def jitter(salt: int, width: int) -> Column:
    """A factor within ``width`` thousandths of 1 that both ends of a pair agree on."""
    draw = (F.col("lo") * 7919 + F.col("hi") * 104_729 + salt) % (2 * width + 1)
    return 1 + (draw - width) / F.lit(1000.0)


def couplings(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(lo, hi, k, m): each pair of neighbouring nodes once, with its stiffness and mass."""
    at = materialise(numbers(spark, nx, ny, nz))
    cell = F.col("cell")
    own = at.select("node", (cell % nx).alias("x"), (F.expr(f"cell div {nx}") % ny).alias("y"), F.expr(f"cell div {nx * ny}").alias("z"))
    steps = [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) > (0, 0, 0)]  # one of each two opposite ones
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in steps]))
    pairs = own.withColumn("o", offsets).select("node", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("z") + F.col("o.dz")).alias("z"), F.expr("abs(o.dx) + abs(o.dy) + abs(o.dz)").alias("d2"))
    pairs = pairs.where(f"x BETWEEN 0 AND {nx - 1} AND y BETWEEN 0 AND {ny - 1} AND z BETWEEN 0 AND {nz - 1}")
    # A merge join at every size: estimates leave out that offsets make thirteen rows of one, so that all pairs were broadcast.
    pairs = pairs.select("node", "d2", ((F.col("z") * ny + F.col("y")) * nx + F.col("x")).alias("cell")).join(at.withColumnRenamed("node", "other").hint("merge"), "cell")
    pairs = pairs.select(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi"), F.col("d2").cast("double").alias("d2"))
    k = F.lit(210.0) / F.col("d2") * jitter(1, 80)
    m = F.lit(7.8) / (F.col("d2") * F.sqrt("d2")) * jitter(2, 50)
    return pairs.select("lo", "hi", k.alias("k"), m.alias("m"))


def matrix(pairs: DataFrame, d: int, kind: str) -> DataFrame:
    """(i, j, v): a d x d block for each pair in both triangles, and a diagonal that outweighs its row."""
    value, same, other, share, grow, add = {"k": (-F.col("k"), 1.0, 0.28, 1.0, 1.15, 100.0), "m": (F.col("m"), 0.35, 0.08, 1.5, 1.25, 10.0)}[kind]
    r = F.explode(F.sequence(F.lit(0), F.lit(d - 1)))
    block = pairs.select("lo", "hi", value.alias("w"), r.alias("a")).select("*", r.alias("b"))
    block = block.select((F.col("lo") * d + F.col("a")).alias("i"), (F.col("hi") * d + F.col("b")).alias("j"), (F.col("w") * F.when(F.col("a") == F.col("b"), same).otherwise(other)).alias("v"))
    both = block.unionAll(block.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    diagonal = both.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).select("i", F.col("i").alias("j"), (F.col("s") * share * grow + add).alias("v"))
    return both.unionAll(diagonal)


def of_parts(spark: SparkSession, sf_dir: str, kind: str, d: int = 3) -> DataFrame:
    """The lattice with about one node for each row of ``part``."""
    return matrix(materialise(couplings(spark, *shape(table(spark, sf_dir, "part").count()))), d, kind)
