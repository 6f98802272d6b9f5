"""Queries through partitioned table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources import table_functions
from larkspur.sources.tables import table

from .registry import query


@query(
    "s15_shift_lines",
    """SELECT conv_id::VARCHAR AS file, turn::VARCHAR AS run, role AS status, CASE WHEN turn % 3 <> 2 THEN 'SNAG' END AS type, CASE WHEN turn % 3 <> 2 THEN turn % 3 + 1.0 END AS severity, CASE WHEN turn % 3 <> 2 THEN turn + 0.5 END AS meters, CASE WHEN turn % 3 = 1 THEN 'role ' || role || ' again' END AS note
    FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)""",
)
def s15_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of lines, one for each turn of a conversation, read in order by a table function in SQL (S15, 2.14)."""
    table_functions.register(spark)
    k, turn = F.col("turn") % 3, F.col("turn").cast("string")
    defect = F.when(k == 0, F.concat(F.lit("DEFECT: SNAG SEV1 AT "), turn, F.lit(".5M"))).when(k == 1, F.concat(F.lit("DEFECT: SNAG SEV2 AT "), turn, F.lit(".5M NOTE=role "), "role"))
    lines = F.array(F.concat(F.lit("RUN: "), turn), F.concat(F.lit("STATUS: "), "role"), defect, F.when(k == 1, "  again"), F.lit(""))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role").distinct()
    each = turns.select(F.col("conv_id").cast("string").alias("file"), "turn", "role", F.posexplode(lines).alias("i", "line")).where("line is not null")
    each.select("file", F.concat_ws(" ", F.format_string("%08d", F.col("turn").cast("long")), "role", F.col("i").cast("string")).alias("n"), "line").createOrReplaceTempView("larkspur_shift_lines")
    got = spark.sql("SELECT * FROM shift_lines(TABLE(SELECT file, n, line FROM larkspur_shift_lines) PARTITION BY file ORDER BY n)")
    return got.select("file", "run", "status", "type", F.col("severity").cast("double").alias("severity"), "meters", "note")
