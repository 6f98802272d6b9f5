"""Queries over catalogues of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import phrases
from larkspur.sources.tables import table

from .registry import query


def item_terms(spark: SparkSession, sf: str) -> DataFrame:
    """(domain, term) of benchmark items: their words of 8 letters or more, each with the word after it, and alone where it is the item's first."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    each = table(spark, sf, "benchmark").select((F.col("item_id") % 4).cast("string").alias("domain"), F.posexplode(words).alias("i", "w"), words.alias("ws"))
    after = F.try_element_at("ws", F.col("i") + 2)
    term = F.when(after.isNotNull(), F.concat_ws(" ", "w", after)).otherwise(F.col("w"))
    long = each.where(F.length("w") >= 8)
    return long.select("domain", term.alias("term")).unionByName(long.where("i = 0").select("domain", F.col("w").alias("term")))


def plain_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with x for every letter outside ASCII, as the SQL knows no other word boundaries."""
    return table(spark, sf, "documents").select("doc_id", "source", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))


TERMS = """b AS (SELECT item_id % 4 AS domain, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM benchmark), e AS (SELECT domain::VARCHAR AS domain, ws, unnest(range(1, len(ws) + 1)) AS i FROM b),
    terms AS (SELECT DISTINCT domain, CASE WHEN i < len(ws) THEN ws[i] || ' ' || ws[i + 1] ELSE ws[i] END AS term FROM e WHERE length(ws[i]) >= 8 UNION SELECT domain, ws[i] FROM e WHERE i = 1 AND length(ws[i]) >= 8)"""
# What one pattern of all terms of a domain finds, the longest first.
FOUND = r"""p AS (SELECT domain, '\b(?:' || string_agg(term, '|' ORDER BY length(term) DESC, term) || ')\b' AS pattern FROM terms GROUP BY domain),
    t AS (SELECT doc_id, source, lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g')) AS text FROM documents), f AS (SELECT doc_id, source, domain, unnest(regexp_extract_all(text, pattern)) AS term FROM t, p)"""


@query("s09_phrase_hits", f"WITH {TERMS}, {FOUND} SELECT doc_id, domain, term, count(*) AS times FROM f GROUP BY ALL")
def s09_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document has each term of a catalogue of words and phrases, domain by domain."""
    found = phrases.occurrences(plain_texts(spark, sf), phrases.catalogue(item_terms(spark, sf)), ["doc_id"])
    return phrases.hits(found, ["doc_id"]).drop("lines")


@query("j14_own_domain", f"WITH {TERMS}, {FOUND} SELECT source, count(DISTINCT doc_id) FILTER (domain = (doc_id % 4)::VARCHAR) AS own, count(DISTINCT doc_id) AS any_domain FROM f GROUP BY source")
def j14_own(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a term of their own domain, and of any domain, by source."""
    found = phrases.occurrences(plain_texts(spark, sf), phrases.catalogue(item_terms(spark, sf)), ["doc_id", "source"])
    each = found.groupBy("doc_id", "source").agg(F.max((F.col("domain") == (F.col("doc_id") % 4).cast("string")).cast("int")).alias("own"))
    return each.groupBy("source").agg(F.sum("own").alias("own"), F.count("*").alias("any_domain"))
