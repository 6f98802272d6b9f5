"""Queries over the dictionary of a corpus's identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import stats
from larkspur.operators import dictionary
from larkspur.session import shared_folder
from larkspur.sources.tables import table

from .registry import query
from .text import KEY


@query("t07_dictionary", "SELECT conv_id, turn, true AS same_length, true AS round_trip, false AS plain_left FROM conversations")
def t07_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn's identifiers by the dictionary of all turns and back by its map: lengths stay, the way back is whole, no enciphered word is left."""
    key = ["conv_id", "turn"]
    texts, folder = table(spark, sf, "conversations").select(*key, "text"), shared_folder(spark, "dictionary")
    dictionary.words_of(texts, key).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    dictionary.dictionary(words, KEY).write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    # Written, as three steps read it.
    dictionary.pseudonymised(texts, words, entries, key).write.parquet(f"{folder}/output")
    out = spark.read.parquet(f"{folder}/output")
    dictionary.words_of(out.select(*key, "output"), key, "output").write.parquet(f"{folder}/words_after")
    words_after = spark.read.parquet(f"{folder}/words_after")
    back = dictionary.restored(out.select(*key, "output"), dictionary.way_back(entries), key, words=words_after).withColumnRenamed("output", "again")
    # Of the words that were enciphered none is a word of its own output, but by chance as another's pseudonym.
    changed = entries.where("kind <> 'plain' AND word <> pseudonym").select("word")
    pseudonyms = entries.where("kind <> 'plain'").select(F.col("pseudonym").alias("word"))
    left = words_after.join(changed.join(pseudonyms, "word", "left_anti"), "word").select(*key).distinct().withColumn("left", F.lit(True))
    both = out.join(back, key).join(left, key, "left")
    return both.select(*key, F.coalesce(F.length("output") == F.length("text"), F.lit(True)).alias("same_length"), F.col("again").eqNullSafe(F.col("text")).alias("round_trip"), F.coalesce("left", F.lit(False)).alias("plain_left"))


@query(
    "m01_remaining_life",
    """WITH x AS (SELECT doc_id, n_chars / 10.0 AS hours, doc_id % 900 AS cycles, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE date_diff('day', DATE '2020-01-01' + (doc_id % 1500)::INTEGER, DATE '2024-06-30') END AS days,
      CASE WHEN doc_id % 4 <> 0 THEN 300.0 END AS lh, CASE WHEN doc_id % 5 <> 0 THEN 700 ELSE 0 END AS lc, CASE WHEN doc_id % 3 <> 0 THEN 1200 END AS ld FROM documents),
    f AS (SELECT *, CASE WHEN lh > 0 THEN hours / lh END AS fh, CASE WHEN lc > 0 THEN cycles / lc::DOUBLE END AS fc, CASE WHEN ld > 0 THEN days / ld::DOUBLE END AS fd FROM x)
    SELECT doc_id, round((CASE WHEN lh > 0 THEN lh - hours END)::DOUBLE, 6) AS hours, (CASE WHEN lc > 0 THEN lc - cycles END)::DOUBLE AS cycles, (CASE WHEN ld > 0 THEN ld - days END)::DOUBLE AS days,
    CASE WHEN fh IS NOT NULL AND fh >= coalesce(fc, fh) AND fh >= coalesce(fd, fh) THEN 'HOURS' WHEN fc IS NOT NULL AND fc >= coalesce(fd, fc) THEN 'CYCLES' WHEN fd IS NOT NULL THEN 'CALENDAR_DAYS' END AS governing_unit FROM f""",
)
def m01(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of three limits, and the one that is used up most (2.12: argmax, days since)."""
    i = F.col("doc_id")
    installed = F.when(i % 6 == 0, "not known").otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (i % 1500).cast("int")).cast("string"))
    life = stats.remaining_life(
        F.col("n_chars") / 10.0, i % 900, stats.days_since(installed, F.lit("2024-06-30").cast("date")),
        F.when(i % 4 != 0, 300.0), F.when(i % 5 != 0, 700).otherwise(0), F.when(i % 3 != 0, 1200),
    )
    got = table(spark, sf, "documents").select("doc_id", life.alias("l"))
    return got.select("doc_id", F.round("l.hours", 6).alias("hours"), F.col("l.cycles").cast("double").alias("cycles"), F.col("l.days").cast("double").alias("days"), "l.governing_unit")


_PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query("h02_keyed_digests", f"SELECT doc_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(text)))) AS digest FROM documents")
def h02(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed digest of each text (2.12: HMAC)."""
    return table(spark, sf, "documents").select("doc_id", stats.hmac_sha256(KEY, F.col("text")).alias("digest"))
