"""Vector codes: product quantisation with exact nearest entries found by slicing and intersecting bit masks.

A vector becomes integers and is cut into parts; each part is coded by the nearest of its codebook's entries. Codebooks
begin as the parts of the smallest ids and are improved in rounds: Spark assigns all parts and sums them by entry, in
each task first, so a round sends at most one sum for each entry and task, and the driver gets one for each entry.

The nearest entry is found without comparing all of them. For each dimension the entries' coordinates are sorted, and
each place in that order has the mask of the entries before it, as unsigned 64-bit words. A radius selects a range in
each dimension; the masks of its two ends differ in the entries of the range, and the ranges of all dimensions are
ANDed: what is left are exactly the entries within the radius in every dimension. Only these are compared. If the best
of them is no farther than the radius, no other entry can be as near, as it is farther away in one dimension alone.
Otherwise the search is repeated with the best one's distance as radius, or a doubled one where none was met. The
first radius is the one that a tenth of the entries have to their own nearest neighbour.

Edge cases: vectors that are null or hold null or non-finite components are dropped. Rows without an id are coded, and
come last in the order of ids that gives the first codebooks; rows that share an id are coded each, in order of their
components there. Fewer vectors than entries give a smaller codebook; equal entries stay, and ties go to the lower index.
Parts of lengths that four doesn't divide differ by one, the longer ones first. Vectors of each length have codebooks of
their own, and their digest. Labels that are null are one group. Components beyond 2**26 after scaling stop the job with
an error, as a sum of squares might not fit in a long. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, join_counted, partitions, tidy
from .hard_negatives import rounded

LARGEST = 1 << 26


@dataclass(frozen=True)
class CodeOptions:
    """scale: of components before they are rounded down. parts: of a vector. entries: of a codebook. rounds: of improving codebooks. batch: parts that are searched at once."""

    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    batch: int = 2048


class Masks:
    """The entries of a codebook, sorted in each dimension, with the masks of the entries before each place."""

    def __init__(self, entries: np.ndarray):
        self.entries, (n, self.dims) = entries, entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()
        self.words = -(-n // 64)
        one = np.zeros((n, self.words), np.uint64)
        one[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.before = np.zeros((self.dims, n + 1, self.words), np.uint64)
        for d in range(self.dims):
            self.before[d, 1:] = np.bitwise_or.accumulate(one[order[:, d]], axis=0)
        self.all = np.bitwise_or.reduce(one, axis=0)
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2) if n <= 1024 else np.zeros((1, 1), np.int64)
        near = np.sort(np.where(np.eye(len(apart), dtype=bool), np.iinfo(np.int64).max, apart).min(axis=1))
        self.radius = int(np.sqrt(min(int(near[len(near) // 10]), 1 << 60))) + 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) of the entries within `radius` of each row of x in every dimension, by rows, then entries."""
        mask = np.repeat(self.all[None], len(x), axis=0)
        for d in range(self.dims):
            low = np.searchsorted(self.sorted[d], x[:, d] - radius, side="left")
            high = np.searchsorted(self.sorted[d], x[:, d] + radius, side="right")
            mask &= self.before[d, high] ^ self.before[d, low]
        bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry to each row of x; the lower index of equals."""
        entry, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(todo):
            row, e = self.within(x[todo], radius)
            apart = ((x[todo[row]] - self.entries[e]) ** 2).sum(axis=1)
            order = np.lexsort((e, apart, row))
            head = order[np.unique(row[order], return_index=True)[1]]
            met = todo[row[head]]
            best[met], entry[met] = apart[head], e[head]
            # Squares of whole numbers: a distance is within the radius if its rounded-up root is.
            root = np.full(len(todo), -1, np.int64)
            root[row[head]] = _root_up(apart[head])
            left = (root < 0) | (root > radius)
            radius = np.where(root < 0, np.minimum(2 * radius, 8 * LARGEST), root)[left]
            todo = todo[left]
        return entry, best


def _root_up(square: np.ndarray) -> np.ndarray:
    """The smallest whole number whose square is `square` or more."""
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root = np.where(root * root > square, root - 1, root)
    return np.where(root * root < square, root + 1, root)


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Where each part of a vector begins and ends."""
    edges = np.cumsum([0, *(width // parts + (k < width % parts) for k in range(parts))]).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


Codebooks = dict[int, list[np.ndarray]]


class Coder:
    """Codes vectors of any length that has codebooks."""

    def __init__(self, books: Codebooks, options: CodeOptions):
        self.masks, self.options = {width: [Masks(b) for b in own] for width, own in books.items()}, options

    def code(self, vectors: list[bytes]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(positions in `vectors`, width, matrix, codes, squared distances of each part) by lengths, in batches."""
        size = np.array([len(v) // 8 for v in vectors])
        for width in np.unique(size).tolist():
            every = np.flatnonzero(size == width)
            for a in range(0, len(every), self.options.batch):
                at = every[a : a + self.options.batch]
                x = np.frombuffer(b"".join(vectors[i] for i in at.tolist()), "<i8").reshape(len(at), width)
                found = [m.nearest(x[:, i:j]) for m, (i, j) in zip(self.masks[width], bounds(width, self.options.parts), strict=True)]
                yield at, width, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_codebooks(rows: DataFrame, options: CodeOptions) -> Codebooks:
    """The parts of the smallest ids, for each length of vectors."""
    widths = sorted(r["width"] for r in rows.select("width").distinct().collect())
    books: Codebooks = {}
    for width in widths:
        least = rows.where(F.col("width") == width).orderBy(F.asc_nulls_last("id"), "v").select("v").limit(options.entries).collect()
        matrix = np.frombuffer(b"".join(bytes(r["v"]) for r in least), "<i8").reshape(len(least), width)
        books[width] = [matrix[:, i:j].copy() for i, j in bounds(width, options.parts)]
    return books


def improved(rows: DataFrame, books: Codebooks, options: CodeOptions) -> Codebooks:
    """Codebooks whose entries are the means, rounded down, of the parts that are nearest to them; unused entries stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, sums = Coder(shared.value, options), {}
        for pdf in batches:
            for _, width, x, codes, _ in coder.code(list(pdf["v"])):
                for p, (i, j) in enumerate(bounds(width, options.parts)):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, begin, count = np.unique(codes[order, p], return_index=True, return_counts=True)
                    total = np.concatenate([np.add.reduceat(x[order, i:j], begin, axis=0), count[:, None]], axis=1)
                    for e, row in zip(used.tolist(), total, strict=True):
                        key = (width, p, e)
                        sums[key] = sums[key] + row if key in sums else row.copy()
        if sums:
            size = [len(v) for v in sums.values()]
            keys = np.repeat(np.array(list(sums), np.int64), size, axis=0)
            yield pd.DataFrame({"width": keys[:, 0], "part": keys[:, 1], "entry": keys[:, 2], "at": np.concatenate([np.arange(n) for n in size]), "total": np.concatenate(list(sums.values()))})

    got = rows.select("v").mapInPandas(run, "width int, part int, entry int, at int, total long").groupBy("width", "part", "entry", "at").agg(F.sum("total").alias("total"))
    out = {width: [b.copy() for b in own] for width, own in books.items()}
    for (width, part, entry), own in got.toPandas().sort_values("at").groupby(["width", "part", "entry"]):
        total = own["total"].to_numpy(np.int64)
        out[width][part][entry] = total[:-1] // total[-1]
    return out


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex of the SHA-256 of all components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(table: DataFrame, options: CodeOptions = CodeOptions(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector of `table`."""
    with Scratch(table.sparkSession) as scratch:
        rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), rounded(F.col(vector_col), options.scale, LARGEST).alias("v")).where("v is not null")
        rows = cut(rows.repartition(partitions(table.sparkSession), "id", "v").withColumn("width", (F.octet_length("v") / 8).cast("int")), "rows", scratch)
        books = first_codebooks(rows, options)
        for _ in range(options.rounds):
            books = improved(rows, books, options)
        shared = table.sparkSession.sparkContext.broadcast(books)
        digests = {width: digest(own) for width, own in books.items()}

        @tidy
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            coder = Coder(shared.value, options)
            for many in batches:
                code, error, sha = np.empty(len(many), object), np.zeros(len(many), np.int64), np.empty(len(many), object)
                for at, width, _, codes, apart in coder.code(list(many)):
                    code[at] = [bytes(c).hex() for c in codes.astype(np.uint8)]
                    error[at], sha[at] = apart.sum(axis=1), digests[width]
                yield pd.DataFrame({"code": code, "error": error, "codebooks_sha256": sha})

        coded = rows.select("id", "label", F.pandas_udf(run, "code string, error long, codebooks_sha256 string")("v").alias("c")).select("id", "label", "c.*")
        # Null labels are one group, told from the others by a column of its own.
        kind = dict(table.dtypes)[label_col]
        coded = cut(coded.withColumn("group", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("none", F.col("label").isNull()), "coded", scratch)
        by_label = cut(coded.groupBy("group", "none").agg(F.sum("error").alias("label_error"), F.count("*").alias("c")), "labels", scratch)
        out = join_counted(coded, by_label, ["group", "none"], coded.count())
        return cut(out.select(F.col("id").alias("vec_id"), F.col("label").cast(kind).alias("label"), "code", "error", "label_error", "codebooks_sha256"), "codes")


def vector_codes(table: DataFrame, options: CodeOptions = CodeOptions()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    return encoded(table, options).drop("label")


def decoded(codes: DataFrame, books: Codebooks, width: int, options: CodeOptions = CodeOptions()) -> DataFrame:
    """`codes` and vector: what each code of vectors of `width` components stands for, as the codebooks' whole numbers."""
    own = books[width]

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            at = np.frombuffer(bytes.fromhex("".join(many)), np.uint8).reshape(len(many), options.parts)
            yield pd.Series(list(np.concatenate([b[at[:, p]] for p, b in enumerate(own)], axis=1)), dtype=object)

    return codes.withColumn("vector", F.pandas_udf(run, "array<long>")("code"))


def _sql(parts: int = 4, rounds: int = 4) -> str:
    """The same result in SQL: all entries compared in each round. For small tables of vectors of one length."""
    nearest = """a{k} AS MATERIALIZED (
  SELECT p.n, p.p, arg_min(b.e, (b.cc - 2 * list_inner_product(p.x, b.c)) * 256 + b.e) AS e, min(b.cc - 2 * list_inner_product(p.x, b.c) + p.xx) AS d
  FROM parts p JOIN b{k} b USING (p) GROUP BY p.n, p.p)"""
    better = """s{j} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT a.p, a.e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k} a JOIN parts USING (n, p), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i) GROUP BY a.p, a.e, i
  ) GROUP BY p, e
), b{j} AS MATERIALIZED (SELECT p, e, coalesce(s.c, b.c)::DOUBLE[] AS c, list_inner_product(coalesce(s.c, b.c)::DOUBLE[], coalesce(s.c, b.c)::DOUBLE[]) AS cc FROM b{k} b LEFT JOIN s{j} s USING (p, e))"""
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [better.format(j=k + 1, k=k), nearest.format(k=k + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding]::DOUBLE[] AS v, len(embedding) // {parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (SELECT n, p, v[p * w + 1 : p * w + w] AS x, list_inner_product(v[p * w + 1 : p * w + w], v[p * w + 1 : p * w + w]) AS xx FROM kept, (SELECT unnest(range({parts})) AS p)
), b0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c, xx AS cc FROM parts WHERE n <= 256
), {", ".join(steps)}, coded AS (
  SELECT n, string_agg(lower(right('0' || to_hex(e), 2)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY n
), whole AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (n), whole
"""


ORACLE = _sql()
