"""What a run saves: permutation, partitions, coarse graph, figures, a printed table; only what is asked for is computed."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband.operators.graph import symmetric
from graphband.plans.multilevel import Run
from graphband.session import ship_package
from graphband.sources import mtx, mtx_source


def permutation_text(order: DataFrame, path: str) -> None:
    """One old row number a line, in new order, in files whose names sort like their ranges."""
    order.repartitionByRange("new").sortWithinPartitions("new").select(F.col("old").cast("string").alias("value")).write.text(path)


def partitions(run: Run) -> DataFrame:
    """(stage, id, p) of the coarse and the final partition."""
    return run.coarse_part.select(F.lit("coarse").alias("stage"), "id", "p").unionByName(run.part.select(F.lit("final").alias("stage"), "id", "p"))


def coarse_graph(run: Run) -> DataFrame:
    """The coarsest graph's adjacency (i, j, v), both triangles."""
    edges, _ = run.chain.graphs[-1]
    return symmetric(edges).select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("v"))


def table_lines(figures: DataFrame, matrix: str) -> list[str]:
    """A printed table of a matrix's figures before and after, by name: about a hundred lines."""
    x = figures.where((F.col("matrix") == matrix) & (F.col("variant") != "check")).groupBy("metric").pivot("variant", ["original", "permuted"]).agg(F.first("value")).orderBy("metric").collect()
    text = lambda v: "-" if v is None else f"{v:.6g}"
    cells = [("metric", "original", "permuted"), *((r["metric"], text(r["original"]), text(r["permuted"])) for r in x)]
    width = [max(len(c[i]) for c in cells) for i in range(3)]
    return ["  ".join([c[0].ljust(width[0]), c[1].rjust(width[1]), c[2].rjust(width[2])]).rstrip() for c in cells]


def save(run: Run, folder: str, outputs: tuple[str, ...] = ()) -> list[str]:
    """Partitions always, and the outputs named; returns the paths.  A folder that is there already is an error."""
    paths = [f"{folder}/partitions"]
    partitions(run).write.partitionBy("stage").parquet(paths[0])
    writers = {
        "permutation": lambda p: permutation_text(run.order, p),
        "coarsened_graph": lambda p: mtx.write(coarse_graph(run), run.chain.graphs[-1][1].count(), p, "coarsest graph"),
        "matrix_k_permuted": lambda p: mtx.write(run.permuted["K"], run.n, p, "K by parts"),
        "matrix_m_permuted": lambda p: mtx.write(run.permuted["M"], run.n, p, "M by parts"),
        "run_metrics": lambda p: run.figures.write.json(p),
    }
    for name in outputs:
        if name in writers:
            suffix = ".mtx" if "matrix" in name or "graph" in name else ""
            paths.append(f"{folder}/{name}{suffix}")
            writers[name](paths[-1])
    return paths


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What ``save`` has left, by name; absent ones are left out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = {x.getPath().getName() for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)}
    readers = {
        "partitions": spark.read.parquet, "permutation": lambda p: spark.read.text(p), "run_metrics": spark.read.json,
        "coarsened_graph.mtx": lambda p: mtx.read(spark, p), "matrix_k_permuted.mtx": lambda p: mtx.read(spark, p), "matrix_m_permuted.mtx": lambda p: mtx.read(spark, p),
    }
    return {name.removesuffix(".mtx"): read(f"{folder}/{name}") for name, read in readers.items() if name in found}


def listing(spark: SparkSession, folder: str, pattern: str = "*.mtx") -> DataFrame:
    """(path, bytes) of matrix files in a folder and those below it; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))


def catalog(spark: SparkSession, folder: str, pattern: str = "*.mtx") -> DataFrame:
    """(path, bytes, rows, cols, nnz, error) of matrix files in a folder and those below it, of their headers alone.

    Tasks look at files side by side; a file that cannot be read has its error in place of sizes.
    """
    ship_package(spark)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, n in zip(b["path"], b["bytes"], strict=True):
                try:
                    store, place = mtx_source._store(path)
                    with store.open_input_stream(place) as f:
                        head = mtx_source.read_header(f)[0]
                    rows.append((path, n, head.rows, head.cols, head.nnz, None))
                except (OSError, ValueError) as e:
                    rows.append((path, n, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "bytes", "rows", "cols", "nnz", "error"]).astype({c: "Int64" for c in ("rows", "cols", "nnz")})

    return listing(spark, folder, pattern).mapInPandas(look, "path string, bytes long, rows long, cols long, nnz long, error string")


def new_folder(spark: SparkSession, root: str, kind: str, at: datetime | None = None) -> str:
    """A folder of its own for a run or a batch, made now: its name has the time (a run's to the microsecond), and _01, _02 ... where that is taken."""
    form = {"run": "run_%Y%m%d_%H%M%S_%f", "batch": "batch_%Y%m%d_%H%M%S"}[kind]
    base = f"{root.rstrip('/')}/{(at or datetime.now()).strftime(form)}"
    for k in range(100):
        place = spark._jvm.org.apache.hadoop.fs.Path(base + (f"_{k:02d}" if k else ""))
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(place) and store.mkdirs(place):
            return place.toString()
    raise FileExistsError(base)
