"""Pictures of sparse matrices at several zooms: counts and dominant parts of square tiles, of bounded size whatever the matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZOOM = 6  # the finest one has 2 ** ZOOM tiles a side


def morton(i: Column, j: Column, bits: int) -> Column:
    """The bits of i and j in turn, i's first: tiles that are near each other have near codes, and a tile's code shifted by two is that of the four-fold one."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out + F.shiftleft(F.shiftright(i, b) % 2, 2 * b + 1) + F.shiftleft(F.shiftright(j, b) % 2, 2 * b)
    return out


def pyramid(entries: DataFrame, part: DataFrame, n: int, d: int = 1, zoom: int = ZOOM) -> DataFrame:
    """(zoom, code, row, col, n, p): how many entries (i, j) of n rows each tile has, and the part (id, p) of most of their rows, d to a node; the smaller one on ties.

    Entries are counted once, by finest tile and part; coarser zooms add up
    these counts.  A row without a part counts as part -1.  There are at most
    4 ** zoom tiles of a zoom, times the parts.
    """
    tile = lambda c: F.expr(f"{c} * {1 << zoom} div {n}")
    rows = entries.select(F.expr(f"i div {d}").alias("id"), tile("i").alias("row"), tile("j").alias("col")).join(part.select("id", "p"), "id", "left")
    finest = rows.groupBy(morton(F.col("row"), F.col("col"), zoom).alias("code"), "row", "col", F.coalesce("p", F.lit(-1)).cast("long").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    levels = finest.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(zoom))))
    up = F.lit(zoom) - F.col("zoom")
    whole = F.pow(F.lit(2), up).cast("long")
    at = levels.select(F.col("zoom").cast("long").alias("zoom"), F.expr(f"shiftright(code, 2 * ({zoom} - zoom))").alias("code"), (F.col("row") - F.col("row") % whole).alias("r"), (F.col("col") - F.col("col") % whole).alias("c"), whole.alias("whole"), "p", "n")
    of_part = at.groupBy("zoom", "code", F.expr("r div whole").alias("row"), F.expr("c div whole").alias("col"), "p").agg(F.sum("n").alias("n"))
    return of_part.groupBy("zoom", "code", "row", "col").agg(F.sum("n").alias("n"), F.max_by("p", F.struct("n", (-F.col("p")).alias("q"))).alias("p")).select("zoom", "code", "row", "col", F.col("n"), "p")
