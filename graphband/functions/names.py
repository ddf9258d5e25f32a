"""Names that are safe as parts of a path."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(name: Column) -> Column:
    """Letters, digits, ``_`` and ``-``; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(name), "[^A-Za-z0-9_-]", "_"), F.lit(""))
