"""Batch functions and windows on a stream."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from larkspur.functions import literals
from larkspur.streaming import breaker as breaker_module
from larkspur.streaming.breaker import BreakerOptions, run_breaker, tripped
from larkspur.streaming.transforms import windowed_counts


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
    q = stream.select(literals.literal_class(F.col("props")).alias("c")).writeStream.format("memory").queryName("classes").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("classes").count() == events.count()


def plain_breaker(rows, options=BreakerOptions()):
    """key -> id of the outcome that trips it, of rows (key, seconds, id, failed)."""
    out, counts = {}, {}
    for key, _, i, failed in sorted(rows, key=lambda r: (r[1], r[2])):
        n, bad = counts.get(key, (0, 0))
        counts[key] = n, bad = n + 1, bad + (failed is not False)
        if n >= options.least and bad / n > options.share and key not in out:
            out[key] = i
    return out


OUTCOMES = "key string, at timestamp, id long, failed boolean"


def deliver(spark, folder, rows, name):
    df = spark.createDataFrame([(k, s, i, f) for k, s, i, f in rows], "key string, s long, id long, failed boolean")
    df.select("key", F.timestamp_seconds("s").alias("at"), "id", "failed").coalesce(1).write.mode("append").parquet(folder)


def outcomes_of(rng, n):
    # Two keys trip, at different times; one stays just under the share; one has too few outcomes.
    rows = []
    for i in range(n):
        key = "abcd"[i % 4] if i % 40 else "rare"
        share = {"a": 0.4, "b": 0.1 if i < n // 2 else 0.9, "c": 0.04, "d": 0.0, "rare": 1.0}[key]
        rows.append((key, 1_700_000_000 + 60 * i, i, None if rng.random() < share / 4 else rng.random() < share))
    return rows


def test_breaker_on_a_stream_equals_the_batch_also_after_restarts(spark, tmp_path):
    rng, source, out = random.Random(5), str(tmp_path / "in"), str(tmp_path / "out")
    rows = outcomes_of(rng, 400)
    # Arrivals are out of order by up to an hour, in six deliveries, each a run of its own that goes on from the checkpoint.
    arriving = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 3600))
    options = BreakerOptions(delay="2 hours")
    for part in [arriving[k::1][:70] for k in range(0, 400, 70)]:
        deliver(spark, source, part, "part")
        stream = spark.readStream.schema(OUTCOMES).parquet(source)
        run_breaker(stream, out, options).awaitTermination()
    end = breaker_module.ending(spark.read.schema(OUTCOMES).parquet(source), F.lit("the end"))
    end.write.mode("append").parquet(source)
    run_breaker(spark.readStream.schema(OUTCOMES).parquet(source), out, options).awaitTermination()
    want = plain_breaker(rows)
    assert {"a", "b"} <= set(want) and "c" not in want and "d" not in want
    assert {r["key"]: r["tripped_at"] for r in tripped(spark, out).collect()} == want
    # A run without anything new changes nothing.
    run_breaker(spark.readStream.schema(OUTCOMES).parquet(source), out, options).awaitTermination()
    assert tripped(spark, out).count() == len(want)


def test_late_outcomes_are_left_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, source, [("a", 1_700_000_000 + 3600 * i, i, False) for i in range(13)], "first")
    stream = lambda: spark.readStream.schema(OUTCOMES).parquet(source)
    run_breaker(stream(), out).awaitTermination()
    # All failures, which would trip it, but behind the watermark; rows without a key, a time or an id take no part.
    deliver(spark, source, [("a", 1_700_000_000 + i, 100 + i, True) for i in range(9)] + [(None, 1_800_000_000, 1, True), ("a", None, 2, True), ("a", 1_700_000_000, None, True)], "late")
    run_breaker(stream(), out).awaitTermination()
    deliver(spark, source, [("a", 1_900_000_000, 200, False)], "end")
    run_breaker(stream(), out).awaitTermination()
    assert tripped(spark, out).count() == 0
