"""Hard negatives: scores of anchors against all rows by Strassen multiplication of integer tiles, kept in mergeable heaps.

Vectors become integers, so scores are exact and their order is the same on every machine. Anchors are a stated set of
rows; they are taken in blocks of bounded size, which are broadcast, and all rows stream past each block, tile by tile.
A tile's scores are a matrix product by Strassen's recursion: both matrices are padded with zeros to even sizes and cut
into quarters, seven products take the place of eight, and sums of 64-bit integers are exact modulo 2**64, so what
overflows on the way does no harm.

The first pass keeps for each anchor a heap of its best rows of the same label, its positives; the second, for each
positive, a heap of the best rows of other labels within its window of scores. A heap holds a few entries whatever it
has seen, and heaps of tasks merge into one by the same order, so no group of rows is ever together: a label, or copies
of one vector, may be any share of the table.

Edge cases: rows without an id, a label or a vector, or whose vector holds null or non-finite components, take no part.
Vectors of other lengths than an anchor's are not compared with it; empty vectors score 0. Rows that share an id are rows
of their own, and each may be an anchor; equal scores go to the smaller id, then to the row that is listed first in the
written table. An anchor without another row of its label gives no rows, nor does a positive without a row in its window
or with a negative score. Components beyond 2**27 after scaling stop the job with an error, as scores might not fit in
a long. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, partitions, tidy

LARGEST = 1 << 27


@dataclass(frozen=True)
class MiningOptions:
    """scale: of components before they are rounded down. positives, negatives: kept for each anchor and positive. low: percent of the positive's score that a negative has at least. block: anchors of a pass, about. tile: rows that are multiplied at once. leaf: side under which a product is done directly."""

    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80
    block: int = 1024
    tile: int = 1024
    leaf: int = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """The product of two int64 matrices."""
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    # Zeros to even sides.
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, m % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), np.int64)
    out[:x, :z], out[:x, z:] = p1 + p4 - p5 + p7, p3 + p5
    out[x:, :z], out[x:, z:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """The best `size` entries (score, then smaller id, then smaller row) of each of n owners."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.entries = np.empty((0, 4), np.int64)  # owner, score, id, row
        # What an entry must beat, by owner: the last of a full heap.
        self.score, self.id = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)

    def wanted(self, score: np.ndarray, ids: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Whether entries may enter; score: (owners, rows)."""
        least = self.score[owners][:, None]
        return (score > least) | ((score == least) & (ids[None] <= self.id[owners][:, None]))

    def push(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        every = np.concatenate([self.entries, np.stack([owner, score, ids, row], axis=1)])
        every = every[np.lexsort((every[:, 3], every[:, 2], -every[:, 1], every[:, 0]))]
        begin = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
        place = np.arange(len(every)) - np.repeat(begin, np.diff(np.append(begin, len(every))))
        self.entries = every[place < self.size]
        full = every[place == self.size - 1]
        self.score[full[:, 0]], self.id[full[:, 0]] = full[:, 1], full[:, 2]


def rounded(vector: Column, scale: int, largest: int = LARGEST) -> Column:
    """A column of little-endian int64 components, floor(scale * x); null where the vector is null or holds null or non-finite components."""

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            out = []
            for v in many:
                v = None if v is None else np.floor(scale * np.asarray(v, np.float64))
                if v is not None and not np.isfinite(v).all():
                    v = None
                if v is not None and (np.abs(v) > largest).any():
                    raise ValueError(f"a component is beyond {largest} after scaling by {scale}")
                out.append(None if v is None else v.astype("<i8").tobytes())
            yield pd.Series(out, dtype=object)

    usable = F.when(~F.exists(vector, lambda x: x.isNull()), vector)
    return F.pandas_udf(run, "binary")(usable.cast("array<double>"))


@dataclass
class Block:
    """Anchors: their rows, ids and labels, their matrix, and with positives the (anchor, positive) pairs' anchor, row, id and score."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    matrix: np.ndarray
    pairs: np.ndarray | None = None


def tiles(batches: Iterator[pd.DataFrame], width: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, labels, matrix) of parts of frames (row, id, label, v)."""
    for pdf in batches:
        for a in range(0, len(pdf), size):
            part = pdf.iloc[a : a + size]
            yield part["row"].to_numpy(), part["id"].to_numpy(), part["label"].to_numpy(), np.frombuffer(b"".join(part["v"]), "<i8").reshape(len(part), width)


# Of a tile this many entries at most meet a heap at once.
PUSHED = 1 << 18


def _push(heaps: Heaps, owners: np.ndarray, ok: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
    """Put what is marked in `ok` (owners, rows) into the heaps of `owners`; of each row of the matrix only what can be among the best."""
    ok &= heaps.wanted(score, ids, owners)
    if score.shape[1] > heaps.size and int(ok.sum()) > 4 * heaps.size * len(owners):
        kth = np.partition(np.where(ok, score, np.iinfo(np.int64).min), -heaps.size, axis=1)[:, -heaps.size]
        ok &= score >= kth[:, None]
    i, j = np.nonzero(ok)
    for a in range(0, len(i), PUSHED):
        own, at = i[a : a + PUSHED], j[a : a + PUSHED]
        heaps.push(owners[own], score[own, at], ids[at], row[at])


def best_positives(batches: Iterator[pd.DataFrame], block: Block, options: MiningOptions) -> pd.DataFrame:
    """(anchor, id, row, score) of the best rows of each anchor's label among the rows of a task."""
    heaps, owners = Heaps(len(block.row), options.positives), np.arange(len(block.row))
    for row, ids, label, matrix in tiles(batches, block.matrix.shape[1], options.tile):
        score = strassen(block.matrix, matrix.T, options.leaf)
        _push(heaps, owners, (block.label[:, None] == label[None]) & (block.row[:, None] != row[None]), score, ids, row)
    e = heaps.entries
    return pd.DataFrame({"anchor": block.row[e[:, 0]], "id": e[:, 2], "row": e[:, 3], "score": e[:, 1]})


def best_negatives(batches: Iterator[pd.DataFrame], block: Block, options: MiningOptions) -> pd.DataFrame:
    """(anchor, positive, id, row, score) of the best rows of other labels in each positive's window among the rows of a task."""
    anchor, positive, top = block.pairs[:, 0], block.pairs[:, 1], block.pairs[:, 2]
    heaps, place = Heaps(len(anchor), options.negatives), np.arange(len(anchor))
    for row, ids, label, matrix in tiles(batches, block.matrix.shape[1], options.tile):
        score = strassen(block.matrix, matrix.T, options.leaf)
        for a in range(0, len(anchor), options.block):
            own = anchor[a : a + options.block]
            s, most = score[own], top[a : a + options.block][:, None]
            ok = (s <= most) & (100 * s >= options.low * most) & (block.label[own][:, None] != label[None])
            _push(heaps, place[a : a + options.block], ok, s, ids, row)
    e = heaps.entries
    return pd.DataFrame({"anchor": block.row[anchor[e[:, 0]]], "positive": positive[e[:, 0]], "id": e[:, 2], "row": e[:, 3], "score": e[:, 1]})


def _passed(rows: DataFrame, block: Block, best: Callable, options: MiningOptions, schema: str) -> DataFrame:
    """What `best` keeps in each task of `rows`; heaps of tasks are merged by the caller."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield best(batches, shared.value, options)

    return rows.select("row", "id", "label", "v").mapInPandas(run, schema)


def _merged(found: DataFrame, owner: list[str], size: int) -> DataFrame:
    """The best `size` of each owner of what the tasks kept, numbered from 1. Each task sends `size` rows for an owner at most."""
    order = Window.partitionBy(*owner).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _block(rows: list, width: int) -> Block:
    return Block(
        np.array([r["row"] for r in rows], np.int64), np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64),
        np.frombuffer(b"".join(bytes(r["v"]) for r in rows), "<i8").reshape(len(rows), width),
    )


def mine(rows: DataFrame, anchor: Column, options: MiningOptions = MiningOptions()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `rows` (id, label: longs, v: of `rounded`).

    anchor: whether a row is an anchor.
    """
    spark, results = rows.sparkSession, []
    with Scratch(spark) as scratch:
        usable = rows.where("id is not null and label is not null and v is not null").select("id", "label", "v", F.coalesce(anchor, F.lit(False)).alias("anchor"))
        # Dealt out evenly, as the work of a row is great; in order of ids, so that heaps settle early.
        dealt = usable.repartition(partitions(spark), "id", "v").sortWithinPartitions("id", "label")
        every = cut(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("width", (F.octet_length("v") / 8).cast("int")), "rows", scratch)
        anchors = cut(every.where("anchor"), "anchors", scratch)
        sizes = {r["width"]: r["n"] for r in anchors.groupBy("width").agg(F.count("*").alias("n")).collect()}
        for width, n in sorted(sizes.items()):
            own, blocks = every.where(F.col("width") == width), -(-n // options.block)
            for k in range(blocks):
                with Scratch(spark) as passing:
                    mine_ = anchors.where((F.col("width") == width) & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)).select("row", "id", "label", "v").collect()
                    if not mine_:
                        continue
                    block = _block(mine_, width)
                    found = _passed(own, block, best_positives, options, "anchor long, id long, row long, score long")
                    positives = cut(_merged(found, ["anchor"], options.positives), "positives", passing)
                    number = {r: i for i, r in enumerate(block.row.tolist())}
                    pairs = [(number[r["anchor"]], r["row"], r["score"]) for r in positives.where("score >= 0").collect()]
                    if not pairs:
                        continue
                    block.pairs = np.array(sorted(pairs), np.int64)
                    found = _passed(own, block, best_negatives, options, "anchor long, positive long, id long, row long, score long")
                    names = spark.createDataFrame(list(zip(block.row.tolist(), block.id.tolist(), strict=True)), "anchor long, anchor_id long")
                    positives = positives.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
                    out = _merged(found, ["anchor", "positive"], options.negatives).join(positives, ["anchor", "positive"]).join(F.broadcast(names), "anchor")
                    results.append(cut(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = none if not results else results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(table: DataFrame, options: MiningOptions = MiningOptions()) -> DataFrame:
    """The negatives of `table` (vec_id, embedding, label): anchors have an id divisible by 100, and of ids divisible by 7 labels are moved on by one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), rounded(F.col("embedding"), options.scale).alias("v"))
    return mine(rows, F.col("id") % 100 == 0, options)


# The same result in SQL. For small tables.
ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding]::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), negatives AS (
  SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""
