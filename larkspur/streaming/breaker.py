"""A breaker on a stream: it trips for a key when too large a share of its outcomes so far are failures.

The outcomes of a key are counted in the order of event time, then of their ids, whatever order they arrive in: what has
arrived waits in the key's state until the watermark has passed it, then it is counted for good. So the stream gives what
the batch computation gives, and a restart from the checkpoint goes on where the run before has stopped. An outcome that
arrives behind the watermark would change what is decided already; it is left out of the count, and is itself counted.

State and skew: a key keeps three numbers and what has arrived within the watermark's delay. A hot key's waiting rows are
bounded by its rate and that delay, not by its history; after it has tripped nothing waits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class BreakerOptions:
    """Outcomes that a key has before it can trip, and the share of failures over which it does. delay: how much later than others an outcome may arrive."""

    least: int = 12
    share: float = 0.25
    delay: str = "10 minutes"


STATE = "n long, bad long, tripped long, waiting_at array<long>, waiting_id array<long>, waiting_bad array<boolean>"
# One row when a key trips.
CHANGES = "key string, tripped_at long, n long, bad long"


def counted(n: int, bad: int, rows: list[tuple[int, int, bool]], options: BreakerOptions) -> tuple[int, int, int | None]:
    """(outcomes, failures, id of the outcome that trips or null) after `rows` (time, id, failed) in order; counting ends when it trips."""
    for _, i, failed in rows:
        n, bad = n + 1, bad + bool(failed)
        if n >= options.least and bad / n > options.share:
            return n, bad, i
    return n, bad, None


def breaker(outcomes: DataFrame, options: BreakerOptions = BreakerOptions()) -> DataFrame:
    """A row (CHANGES) for each key that trips, of a stream of outcomes (key: string, at: timestamp, id: long, failed: boolean).

    Rows without a key, a time or an id take no part; a null outcome is a failure.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, bad, tripped, waiting = 0, 0, None, []
        if state.exists:
            n, bad, tripped, at, ids, failed = state.get
            waiting = list(zip(at, ids, failed, strict=True))
        for pdf in batches:
            if tripped is None:
                waiting += zip(pdf["micros"].tolist(), pdf["id"].tolist(), pdf["failed"].tolist(), strict=True)
        if tripped is not None:
            return
        past = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        ready = [r for r in waiting if r[0] < past]
        n, bad, tripped = counted(n, bad, ready, options)
        waiting = [] if tripped is not None else waiting[len(ready) :]
        state.update((n, bad, tripped, [r[0] for r in waiting], [r[1] for r in waiting], [bool(r[2]) for r in waiting]))
        if waiting:
            # To be called when the watermark has passed the first that waits, though no more may arrive.
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if tripped is not None:
            yield pd.DataFrame({"key": [key[0]], "tripped_at": [tripped], "n": [n], "bad": [bad]})

    usable = outcomes.where("key is not null and at is not null and id is not null")
    rows = usable.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), F.col("id").cast("long").alias("id"), F.coalesce(F.col("failed"), F.lit(True)).alias("failed"))
    marked = rows.withWatermark("at", options.delay)
    return marked.groupBy("key").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_breaker(outcomes: DataFrame, folder: str, options: BreakerOptions = BreakerOptions()) -> StreamingQuery:
    """Start a run over what the stream has now; changes go to `folder`/changes, and its place to `folder`/checkpoint. A later call goes on from there."""
    return breaker(outcomes, options).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def tripped(spark: SparkSession, folder: str) -> DataFrame:
    """(key, tripped_at) of the keys that have tripped; tripped_at is the id of the outcome."""
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes").select("key", "tripped_at")


def ending(outcomes: DataFrame, key: Column) -> DataFrame:
    """One outcome long after all others, under a key of its own: it moves the watermark past the end of a finite stream."""
    last = outcomes.agg((F.max("at") + F.expr("interval 1000 days")).alias("at")).where("at is not null")
    return last.select(key.alias("key"), "at", F.lit(0).cast("long").alias("id"), F.lit(False).alias("failed"))
