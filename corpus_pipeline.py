"""A training corpus from documents: each stage takes what the one before kept.

Stages: language identification (documents without a language go), near-duplicates (one of each group stays), repeated
passages (their later copies go), secrets (masked), packing (sequences of tokens, each document with an end mark). All but
the last return the columns of documents.

Edge cases: null and empty texts, and those without a letter, have no language and go in the first stage. Rows without
an id are kept by every stage: they are near nobody and repeat nothing. Rows that share an id are one near-duplicate
group, and of the group the rows with its smallest id stay; repeats are taken out of all of them. Ties go to the smaller
id. Very long texts are processed whole. Extra columns pass all stages but packing, whatever their names. Empty tables
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, langid, minhash, packing, secrets, substring

# A language must be likelier than all others together.
LEAST_SCORE = 0.5
# Percent of the word shingles of two documents together that near-duplicates share at least.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not those without a letter, nor those that no language fits better than all others."""
    return langid.reject_unknown(docs, langid.train(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_first(docs, minhash.LinkOptions(percent=NEAR_PERCENT))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier."""
    return substring.without_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, packing.token_length(F.col("text")))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

# Minimal SQL has no language model, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result but the last is written and read again, and goes when the next is there."""
    docs, before = common.read_table(spark, sf_dir, "documents"), common.Scratch(spark)
    for name, stage in STAGES[:-1]:
        after = common.Scratch(spark)
        with before:
            docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "_"), after)
        before = after
    # The last result may read its input when it is asked for rows.
    return STAGES[-1][1](spark, docs, sf_dir)
