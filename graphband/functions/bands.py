"""Widths of diagonal bands."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percents(number: str) -> Column:
    """0, 0.05 ... in IEEE doubles."""
    return F.col(number).cast("double") * F.lit(5.0) / F.lit(100.0)


def band_width(percent: Column, n: int) -> Column:
    """Rows in a band of that percentage: 0 at 0, else 1 at least, rounded up."""
    return F.when(percent <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(percent / F.lit(100.0) * F.lit(float(n))))).cast("long")


def band_label(percent: Column) -> Column:
    """``1.0%`` of whole percents, else no trailing zeros: ``0.05%``."""
    short = F.regexp_replace(F.format_string("%.10f", percent), r"\.?0+$", "")
    return F.concat(F.when(percent == F.floor(percent), F.format_string("%.1f", percent)).otherwise(short), F.lit("%"))
