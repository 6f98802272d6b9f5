"""The registered queries of the training-data operators, on their whole tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, embedding_dedup, fingerprint, hard_negatives, langid, minhash, packing, quality, secrets, substring, token_store, toxicity, vector_codes


def remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, mod n; null where doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, read back from binary shards through their index."""
    return token_store.digests(common.read_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to."""
    return bpe.digests(common.read_table(spark, sf_dir, "documents"))


def op3_quality_rqda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learnt from labels outside the held-out fold."""
    docs = common.read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    x = common.cut(docs.select("doc_id", quality.features(F.col("text")).alias("x")), "features")
    labels = common.read_table(spark, sf_dir, "labels").where(~held_out & F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(x.join(labels, "doc_id").select("label", "x"))
    score = quality.score(F.col("x"), model)
    return x.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents, at a resemblance of 0.85 of 5-word shingles."""
    return minhash.near_duplicates(common.read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that no repeated window of 20 words covers."""
    return substring.digests(common.read_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label at a cosine of 0.93."""
    return embedding_dedup.near_vectors(common.read_table(spark, sf_dir, "embeddings"))


def op7_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    return fingerprint.digests(common.read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learnt from lang outside the held-out fold."""
    docs = common.read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.identify(F.col("text"), model).alias("got")).select("doc_id", "held_out", "got.*")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 to 16,384 tokens that hold all documents."""
    docs = common.read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, packing.token_length(F.col("text")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, by patterns and token efficiency."""
    return secrets.scan_secrets(common.read_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document with its disguised words restored, learnt from labels outside the held-out fold."""
    docs = common.read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of other labels just under each positive's score, for every hundredth vector."""
    return hard_negatives.hard_negatives(common.read_table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of each vector by four codebooks of 256 entries, and their errors."""
    return vector_codes.vector_codes(common.read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rqda": op3_quality_rqda,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_merkle_fingerprint": op7_merkle_fingerprint,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op4_minhash_near_dedup": minhash.ORACLE, "op5_substring_dedup": substring.ORACLE, "op6_embedding_near_dedup": embedding_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
