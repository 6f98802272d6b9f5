"""Best-fit packing of documents into sequences of several permitted lengths.

Every permitted length has a cost: its length plus a fixed cost for each sequence. Pieces are packed longest first.
Each goes to the open bin that it fills best; if none has room, a bin is opened: of the permitted lengths that hold the
piece, the one of least cost for each unit filled, where what is left over counts as filled by the expected share. At
the end each bin is downsized to the smallest permitted length that holds its contents. A document longer than the
largest length is first cut into pieces of it, so nothing is lost.

Bins are packed in groups of about `group` pieces, dealt by a hash of the document, so that no task holds more; with
some thousand pieces a group's loss against one global packing is well under a hundredth.

Edge cases: an empty or null text has just its end mark. Rows that share an id are packed as rows
of their own. A null id is kept. An empty table gives no rows. Ties go to the bin opened first and to the smaller length.
A very long text is cut into pieces like any other. Other columns of the input are left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import release, tiktoken_cached
from .common import complete_groups, cut, partitions, slices, tidy, vocabulary


@dataclass(frozen=True)
class PackOptions:
    """lengths: permitted, in units. overhead: cost of a sequence besides its length. group: pieces packed together, about. refill: share of a new bin's room that later pieces are expected to fill."""

    lengths: tuple[int, ...] = (2048, 4096, 8192, 16384)
    overhead: int = 64
    group: int = 2048
    refill: float = 0.9


def least_cost(size: int, options: PackOptions) -> int:
    """The length to open for a piece: least cost for what the bin is expected to hold."""
    fits = [c for c in options.lengths if c >= size]
    return min(fits, key=lambda c: ((c + options.overhead) / (size + options.refill * (c - size)), c))


def pack(sizes: np.ndarray, options: PackOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in the bin, length of the bin) of each piece; sizes are at most the largest length."""
    order = np.argsort(-sizes, kind="stable")
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    used: list[int] = []
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(used), least_cost(size, options)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if free > size:
            bisect.insort(room, (free - size, b))
    lengths = sorted(options.lengths)
    final = np.array([lengths[bisect.bisect_left(lengths, u)] for u in used], np.int64)
    return bins, offsets, final[bins] if len(used) else np.zeros(0, np.int64)


def pack_documents(docs: DataFrame, length: Column, options: PackOptions = PackOptions()) -> DataFrame:
    """(doc_id, piece, start, size, bin_id, offset, capacity): where each piece of each row of `docs` lies.

    length: units of a row, its end mark included. start and size: the piece's range within the row. bin_id: group and
    number of the bin.
    """
    spark = docs.sparkSession
    most = max(options.lengths)
    # Written, so that lengths are counted once; they are read for the number of groups and for packing.
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(length.cast("long"), F.lit(1)).alias("n")), "sizes")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))))
    pieces = pieces.withColumn("start", F.col("piece") * most).withColumn("size", F.least(F.lit(most), F.col("n") - F.col("start")))
    groups = int(pieces.count() // options.group) + 1
    # Rows that are alike are spread too.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "n", "piece"), F.lit(groups)).cast("long"))
    dealt = dealt.repartition(min(groups, 8 * partitions(spark)), "group").sortWithinPartitions("group", F.desc("size"), "doc_id", "piece")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for many in complete_groups(batches, ["group"], 4 * options.group):
            for group, pdf in many.groupby("group", sort=False):
                bins, offset, capacity = pack(pdf["size"].to_numpy(), options)
                named = [f"{group}-{b}" for b in bins.tolist()]
                yield pdf[["doc_id", "piece", "start", "size"]].assign(bin_id=named, offset=offset, capacity=capacity)

    return dealt.mapInPandas(run, "doc_id long, piece long, start long, size long, bin_id string, offset long, capacity long")


def token_length(text: Column, vocabulary_name: str = "byte_bpe_50k.tiktoken") -> Column:
    """Tokens of a text, with an end mark."""
    path = vocabulary(vocabulary_name)

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tiktoken_cached(path)
        try:
            for texts in slices(batches):
                yield pd.Series([len(encode(t)) // encode.dtype.itemsize + 1 for t in texts], dtype="int64")
        finally:
            # The worker lives on, and what comes after packing has no use for this.
            release(path)

    return F.pandas_udf(run, "long")(text)


def byte_length(text: Column) -> Column:
    """Bytes of a text, with an end mark: its tokens in a vocabulary of bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)) + 1
