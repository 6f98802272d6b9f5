"""Queries over runs that are repeated, tables that change together, and streams that are stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import runs
from larkspur.session import shared_folder
from larkspur.sources.tables import table
from larkspur.sources.versions import KeyedSink, Kinds, VersionedTables
from larkspur.streaming import breaker

from .registry import query


@query(
    "k01_repeated_run",
    """SELECT conv_id, turn, CASE WHEN text IS NOT NULL AND length(text) % 11 <> 0 THEN sha256('artifact of ' || text) END AS artifact_sha256, CASE WHEN text IS NULL THEN 'refused' WHEN length(text) % 11 = 0 THEN 'refused' END AS error_code,
    CASE WHEN text IS NOT NULL AND length(text) % 11 <> 0 AND length(text) % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts FROM conversations""",
)
def k01_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """A run in which some jobs fail and some are refused, and a second one: each key has one result, and refusals aren't tried again."""

    class Refused(Exception):
        code = "refused"

    def attempt(first: bool):
        def run(text: str | None) -> str:
            if text is None or len(text) % 11 == 0:
                raise Refused("no artifact of this text")
            if first and len(text) % 3 == 0:
                raise TimeoutError("the first run has no time for it")
            return f"artifact of {text}"

        return lambda jobs: runs.run_cases(jobs, ["conv_id", "turn"], run, ["text"], "artifact string").drop("elapsed_ms")

    sink = KeyedSink(spark, shared_folder(spark, "sink"), ["conv_id", "turn"], Kinds(permanent=("refused",)))
    jobs = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    for first in (True, False):
        sink.run(jobs, attempt(first))
    tries = sink.attempts().groupBy("conv_id", "turn").agg(F.count("*").alias("attempts"))
    got = sink.results().join(tries, ["conv_id", "turn"])
    return got.select("conv_id", "turn", F.sha2("artifact", 256).alias("artifact_sha256"), F.col("error.code").alias("error_code"), "attempts")


@query(
    "k07_versions",
    """WITH d AS (SELECT source, count(*) AS documents FROM documents GROUP BY source), l AS (SELECT source, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT 1 AS version, source, documents, coalesce(good, 0) AS good FROM d LEFT JOIN l USING (source) UNION ALL SELECT 2, source, documents, documents FROM d""",
)
def k07(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and labels as one version, and the next in which every document has a good label: each is read whole, a failed third leaves nothing."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality")
    store = VersionedTables(spark, shared_folder(spark, "versions"))
    store.seed_if_empty({"documents": docs, "labels": labels})
    store.seed_if_empty({"documents": docs.limit(0), "labels": labels.limit(0)})
    store.update(lambda t: {"labels": t["documents"].select("doc_id", F.lit(1).alias("quality"))})
    killed = labels.select("doc_id", F.raise_error(F.lit("killed")).cast("int").alias("quality"))
    try:
        store.commit({"documents": docs.where("doc_id < 0"), "labels": killed})
    except Exception as e:
        if "killed" not in str(e):
            raise
    every = []
    for version in range(1, store.version() + 1):
        t = store.tables(version)
        good = t["documents"].join(t["labels"].where("quality = 1").select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("good"))
        sizes = t["documents"].groupBy("source").agg(F.count("*").alias("documents"))
        every.append(sizes.join(good, "source", "left").select(F.lit(version).alias("version"), "source", "documents", F.coalesce("good", F.lit(0)).alias("good")))
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


@query(
    "a39_breaker_stream",
    "WITH x AS (SELECT source, doc_id, row_number() OVER w AS n, sum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END) OVER w AS bad FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, min(doc_id) AS tripped_at FROM x WHERE n >= 12 AND bad / n::DOUBLE > 0.25 GROUP BY source",
)
def a39_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The first document at which a running share of short ones trips its source's breaker, by a stream that is stopped and goes on from its checkpoint."""
    folder = shared_folder(spark, "breaker")
    outcome = [F.col("source").alias("key"), F.timestamp_seconds("doc_id").alias("at"), F.col("doc_id").cast("long").alias("id"), (F.col("n_chars") < 500).alias("failed")]
    docs = table(spark, sf, "documents")
    # The end of a finite stream comes as one more outcome, from a folder of its own, before the second run. As a pattern
    # the other path may be a file or a folder.
    ends, end = f"{folder}/end", breaker.ending(docs.select(*outcome), F.lit("the end"))
    end.limit(0).write.parquet(ends)
    for k in range(2):
        if k:
            end.write.mode("append").parquet(ends)
        stream = spark.readStream.schema(docs.schema).parquet(f"{sf}/documents.parque[t]").select(*outcome)
        breaker.run_breaker(stream.unionByName(spark.readStream.schema(end.schema).parquet(ends)), folder).awaitTermination()
    return breaker.tripped(spark, folder).select(F.col("key").alias("source"), "tripped_at")
