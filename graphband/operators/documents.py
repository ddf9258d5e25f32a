"""Documents of any shape: their leaves by path, and differences between two versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphband.session import discard, materialise


DOCS = 20_000  # documents that one task parses first


def leaves(docs: DataFrame) -> DataFrame:
    """(doc, path, value) of the leaves of JSON texts (doc, json): paths like $.a.b[0], values as text, null for null.

    A level of nesting is unpacked in each round, for all documents together; a
    leaf is written once, as text, and only what is nested is parsed again.  A
    text that is not JSON has one leaf, itself, at its root.  Empty objects
    and arrays have no leaf.  Documents are dealt to tasks by their number: their
    files may be too small to be split, however long parsing takes.
    """
    docs = docs.repartition(1 + docs.count() // DOCS)
    parsed = F.try_parse_json("json")
    rows = docs.where("json IS NOT NULL").select("doc", F.lit("$").alias("path"), "json", parsed.alias("v"))
    # As text and back, a value that is not JSON keeps what JSON can write of it.
    bad = F.get_json_object(F.to_json(F.struct(F.col("json").alias("x"))), "$.x")
    left = materialise(_told(rows, F.when(F.col("v").isNull(), bad)))
    done, spark = [], docs.sparkSession
    while True:
        done.append(left.where("NOT nested").select("doc", "path", F.col("text").alias("value")))
        v = left.where("nested").select("doc", "path", F.parse_json("text").alias("v"))
        inner = v.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        left = materialise(_told(inner.select("doc", F.concat("path", step).alias("path"), F.col("value").alias("v"))))
        if left.isEmpty():
            discard(left)
            return reduce(DataFrame.unionAll, done)


def _told(rows: DataFrame, bad: Column | None = None) -> DataFrame:
    """(doc, path, nested, text) of variants v: a leaf's value, null for null, or the JSON of what is nested; ``bad`` where there is no variant."""
    nested = F.coalesce(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"), F.lit(False))
    text = F.when(nested, F.to_json("v")).otherwise(F.col("v").cast("string"))
    return rows.select("doc", "path", nested.alias("nested"), (text if bad is None else F.coalesce(bad, text)).alias("text"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, path, a, b, change) of leaves (doc, path, value) that are not the same on both sides."""
    x = a.select("doc", "path", F.col("value").alias("a"), F.lit(True).alias("in_a")).join(b.select("doc", "path", F.col("value").alias("b"), F.lit(True).alias("in_b")), ["doc", "path"], "full")
    change = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").otherwise("changed")
    return x.where("in_a IS NULL OR in_b IS NULL OR NOT (a <=> b)").select("doc", "path", "a", "b", change.alias("change"))
