"""Readers of record folders, with explicit schemas, and of source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Suffixes of source files, and what a tree's walk leaves out.
SOURCES, LEFT_OUT = r"\.(go|tsx?)$", r"/node_modules/|_test\.go$|\.test\.[^/]*$"


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document for each file, and the file's name; a malformed one is an error."""
    got = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return got.withColumn("file", F.col("_metadata.file_name"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document for each line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def without_errors(records: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(records without an error, those with one)."""
    return records.where(F.col(error).isNull()), records.where(F.col(error).isNotNull())


def source_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, bytes) of source files below a folder; tests and dependencies are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = files.where(F.col("path").rlike(SOURCES) & ~F.col("path").rlike(LEFT_OUT))
    return kept.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def pending(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs whose key has no result yet: a run that is started again does only these."""
    return jobs.join(done.select(*key).distinct(), key, "left_anti")


def required(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which a row of `df` without a partner is an error."""
    marked = df.join(other.withColumn("_there", F.lit(True)), on, "left")
    absent = F.raise_error(F.concat(F.lit("no record for "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))).cast("boolean")
    return marked.withColumn("_there", F.coalesce("_there", absent)).where("_there").drop("_there")
