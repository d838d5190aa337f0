"""Reading labelled corpora, and writing what an evaluation found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EXAMPLE


def read_examples(spark: SparkSession, path: str, strict: bool = False, limit: int | None = None) -> DataFrame:
    """Examples of a JSONL file: ``email_text``, ``lines`` (under its older name too), ``metadata``; empty lines are
    skipped.  A line that is no JSON fails the read if ``strict``; else it is skipped and counted by ``rejected``."""
    if strict:
        rows = spark.read.schema(EXAMPLE).option("mode", "FAILFAST").json(path)
    else:
        schema = T.StructType([*EXAMPLE.fields, T.StructField("_corrupt", T.StringType())])
        parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("e")).select("e.*")
        rows = rows.where("_corrupt is null").drop("_corrupt")
    if limit is not None:  # of a run that is asked to look at a few only
        rows = rows.limit(limit)
    return rows.withColumn("lines", F.coalesce("lines", "line_labels")).drop("line_labels")


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a JSONL file that are no JSON."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.where(F.try_parse_json("value").isNull())


def read_example(spark: SparkSession, path: str, index: int) -> DataFrame:
    """The example in the ``index``-th line of a file, from 0 and counting empty lines; an error if there is none."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().filter(lambda x: x[1] == index).map(lambda x: (x[0],))
    found = spark.createDataFrame(lines, "value string").select(F.from_json("value", EXAMPLE).alias("e")).select("e.*")
    if found.isEmpty():
        raise ValueError(f"{path} has no line {index}")
    return found


def write_failures(failures: DataFrame, path: str, limit: int = 20, order: str | None = None) -> None:
    """A readable report of the first failures, by the column ``order`` if there is one, as text."""
    parts = [F.concat_ws(": ", F.lit(c), F.col(c).cast("string")) for c in failures.columns]
    first = (failures if order is None else failures.orderBy(order)).limit(limit)
    first.select(F.concat_ws("\n", *parts, F.lit("-" * 60)).alias("value")).coalesce(1).write.mode("overwrite").text(path)
