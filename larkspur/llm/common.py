"""What the training-data operators share: tables, durable intermediates, sorted streams, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an error, as executors
    would write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's JVM ends, if not before."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
# What is sent to a Python worker at once, and how many rows of whole texts are decoded at once.
BOUNDS = {BATCH_BYTES: "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bound_batches(spark: SparkSession) -> None:
    """Bound batches of texts for the rest of the session, for operators whose last step runs when their result is read.

    Values that the session was given stay.
    """
    given = spark.conf.getAll
    for key, value in BOUNDS.items():
        if key not in given:
            spark.conf.set(key, value)


def cut(df: DataFrame, kind: str = "table", scratch: Scratch | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage and survives lost executors.

    With `scratch` the table goes when that block ends; without, when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    if scratch is not None:
        scratch.paths.append(path)
    # Rows are whole texts or sets of hashes, and Python holds a batch several times over.
    if BATCH_BYTES in spark.conf.getAll:
        df.write.parquet(path)
    else:
        spark.conf.set(BATCH_BYTES, "4m")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(BATCH_BYTES)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator, deleted at the end of a `with` block. What is read later is cut without it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            fs, where = _hadoop(self.spark, path)
            fs.delete(where, True)


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, idle, beside those of the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`task`, a function of batches, which gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pd.Series], chars: int = 1 << 20) -> Iterator[pd.Series]:
    """Texts in parts of about `chars` characters. Spark bounds a batch by bytes; what a task makes of it is bounded here."""
    for texts in batches:
        size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        edges = np.flatnonzero(np.diff(np.cumsum(size) // chars)) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(texts)], strict=True):
            if a < z:
                yield texts.iloc[a:z]


def record_slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most `rows` rows, fewer where a part would have more than about `size` bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` has in no spelling, as names are compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def complete_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Regroup a stream sorted by `keys` into frames of about `rows` rows that never split a key."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < rows:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        last = np.ones(len(whole), bool)
        for k in keys:
            last &= (whole[k] == whole[k].iloc[-1]).to_numpy()
        at = len(whole) - int(last.sum())
        if at:
            yield whole.iloc[:at].reset_index(drop=True)
        held = [whole.iloc[at:].reset_index(drop=True)]
        size = len(whole) - at
    if size:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)


# Bits of the map that `marked` makes: 2 MB, whatever the input.
MAP_BITS = 1 << 24


def split_by(df: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of `df` that may have a key among `wanted`, the other rows), without a shuffle of `df`; columns as in `df`.

    The keys' hashes mark a map of fixed size, which is broadcast in words. With more keys than the map has bits it
    marks everything, so a join must follow; that join then shuffles only what is marked.
    """
    word, bits = fresh(df, "_word", "_map")
    at = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {MAP_BITS}) % 64 AS int))")
    words = wanted.select((at / 64).cast("int").alias(word), bit.alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    out = df.withColumn(word, (at / 64).cast("int")).join(F.broadcast(words), word, "left")
    may = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return out.where(may).drop(word, bits), out.where(~may).drop(word, bits)


# Keys that have this many rows and more than 1 / MOST_HOT of all rows are hot, so there are at most MOST_HOT of them.
HOT_ROWS, MOST_HOT = 10_000, 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, count: str = "c") -> DataFrame:
    """`rows` joined with `keyed`, which has one row for each key and the number of its rows; `total`: of all rows.

    Rows of hot keys are not shuffled: the hot part of `keyed` is broadcast, and its size is bounded by what hot means.
    """
    bound = max(HOT_ROWS, total // MOST_HOT)
    hot = keyed.where(F.col(count) > bound)
    if hot.isEmpty():
        return rows.join(keyed, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.where(F.col(count) <= bound), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, which has none: each component is a star around its least."""
    n = pairs.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
    return n["n"] == n["d"] and pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of `edges` (a, b: longs): component is the smallest id reachable.

    Alternating large-star and small-star steps. Each is a minimum per node, which Spark pre-aggregates, and an
    equi-join, whose hot keys adaptive execution can split; nothing is gathered per component. The result is valid until
    `scratch` ends.
    """
    spark = edges.sparkSession
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last = Scratch(spark)
    pairs = cut(ordered, "edges", last)
    for _ in range(max_rounds):
        if _are_stars(pairs):
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        done, last = last, Scratch(spark)
        with done:
            pairs = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges", last)
    else:
        raise RuntimeError("components did not settle")
    scratch.paths += last.paths
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def limit_threads() -> None:
    """One thread for each task; Spark has a task for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
