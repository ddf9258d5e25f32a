"""Matrix Market files: header inspection, reading as (i, j, v), writing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Header:
    rows: int | None
    cols: int | None
    nnz: int | None
    format: str = "coordinate"
    field: str = "real"
    symmetry: str = "general"


def _head_file(spark: SparkSession, path: str) -> tuple[str, tuple[str, ...]]:
    """The file with the header, which stands first by name, and the other part files of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.getFileStatus(place).isDirectory():
        return path, ()
    names = sorted(x.getPath().toString() for x in store.listStatus(place) if x.getLen() and not x.getPath().getName().startswith(("_", ".")))
    return names[0], tuple(names[1:])


def inspect(spark: SparkSession, path: str) -> Header:
    """The header alone; damaged parts become None or the usual value.  Comments may be of any length: the first other line has the sizes."""
    lines = spark.read.text(_head_file(spark, path)[0]).where("trim(value) <> ''")
    banner = lines.where(F.lower("value").startswith("%%matrixmarket")).first()
    words = banner[0].lower().split() if banner else []
    kind = words[2:5] if len(words) >= 5 else ["coordinate", "real", "general"]
    counts = lines.where(~F.col("value").startswith("%")).first()
    try:
        rows, cols, nnz = (int(x) for x in counts[0].split())
    except (TypeError, ValueError):
        rows = cols = nnz = None
    return Header(rows, cols, nnz, *kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """0-based entries (i, j, v) of a coordinate file, or a folder of its parts; symmetric storage is expanded, duplicates are summed."""
    if not path.endswith(".mtx"):
        raise ValueError(f"not a .mtx file: {path}")
    head = inspect(spark, path)
    if head.rows is None or head.format != "coordinate" or head.field not in ("real", "integer", "pattern"):
        raise ValueError(f"cannot read {path}: {head}")
    first, others = _head_file(spark, path)

    def parts(*files: str) -> DataFrame:
        c = F.split(F.trim("value"), r"\s+")
        body = spark.read.text(list(files)).where("NOT startswith(value, '%') AND trim(value) <> ''").select(c.alias("c"), F.monotonically_increasing_id().alias("at"))
        return body.select(F.col("c")[0].cast("long").alias("a"), F.col("c")[1].cast("long").alias("b"), F.get("c", 2).cast("double").alias("v"), "at")

    # The size line looks like an entry: it is the first of its file, whose splits come in their order.
    own = parts(first)
    entries = own.where(F.col("at") != F.lit(own.agg(F.min("at")).first()[0])).drop("at")
    if others:
        entries = entries.unionAll(parts(*others).drop("at"))
    value = F.lit(1.0) if head.field == "pattern" else F.col("v")
    entries = entries.select((F.col("a") - 1).alias("i"), (F.col("b") - 1).alias("j"), value.alias("v"))
    if head.symmetry != "general":
        sign = -1.0 if head.symmetry == "skew-symmetric" else 1.0
        entries = entries.unionAll(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def write(entries: DataFrame, n: int, path: str, comment: str = "") -> None:
    """A Matrix Market text with general storage, entries in row order, in part files that follow each other by name.

    Ranges of rows are written side by side; the first file alone has the header.
    """
    nnz = entries.count()
    head = ["%%MatrixMarket matrix coordinate real general", *([f"%{comment}"] if comment else []), f"{n} {n} {nnz}"]
    top = entries.sparkSession.createDataFrame([(-1, k, x) for k, x in enumerate(head)], "i long, j long, value string")
    body = entries.select("i", "j", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    top.unionAll(body).repartitionByRange("i", "j").sortWithinPartitions("i", "j").select("value").write.text(path)
