"""Token ids in raw binary shards, with a minimal perfect hash index for keyed access.

Shards: documents are dealt by ranges of their id and sorted; each task writes the ids of its documents, each followed
by an end id, to one file of little-endian integers (16 bits if the vocabulary allows, else 32). Shard and document
order together are ascending id order. A file's name is drawn anew for each attempt of a task, and only names that
come back through Spark's committed table count, so lost or repeated attempts leave nothing that is read.

Index: keys are dealt by hash to parts. Each part has a minimal perfect hash function (levels of bits: a key that is
alone at its bit stays, others go to the next level; the rank of the bit is the slot), and for each slot a fingerprint
of the key, the shard, the offset and the number of ids. A look-up reads one part, computes one slot, compares the
fingerprint and reads one range of one shard. Keys themselves aren't stored.

Edge cases: a null or empty text is an end id alone. Rows that share an id are numbered in the order written (by a hash
of the text; equal texts are a tie that changes nothing) and the number is part of the key. A null id is a key of its own
and sorts first. An empty table gives no shard with rows. A very long text is one row of one task. Other columns of the
input are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import release, tokenizers_cached
from .common import bound_batches, cut, new_path, partitions, record_slices, tidy, vocabulary
from .words import GOLD, mix

BLOCK = 2 << 20


def filesystem(uri: str):
    """The file system and path of a folder in the shared storage; works on executors too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def key_hash(doc_id: np.ndarray, null: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """64-bit hashes of keys (id or null, number of the copy)."""
    return mix(mix(doc_id.astype(np.int64).view(np.uint64) + GOLD * (copy.astype(np.uint64) + np.uint64(1))) + null.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash function over distinct 64-bit integers."""

    LEVELS, SPARE = 24, 1.7

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        left = keys
        while len(left) and len(self.bits) < self.LEVELS:
            at = self._place(left, len(self.bits), size := int(len(left) * self.SPARE) + 1)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = left[~alone[at]]
        # What never stands alone (none but for very small sets) is listed.
        self.rest = np.sort(left)
        counts = [int(b.sum()) for b in self.bits]
        self.base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.rank = [np.cumsum(b) - 1 for b in self.bits]
        self.size = int(self.base[-1]) + len(self.rest)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * int(GOLD) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """0 to size - 1, each once, for the keys it was made of; any slot or -1 for others."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = self._place(keys[todo], level, len(bits))
            here = bits[at]
            out[todo[here]] = self.base[level] + self.rank[level][at[here]]
            todo = todo[~here]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.base[-1] + at[hit]
        return out

    def pack(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array([len(b) for b in self.bits], np.int64), "bits": np.packbits(np.concatenate([*self.bits, np.zeros(0, bool)])), "rest": self.rest}

    @classmethod
    def unpack(cls, x) -> PerfectHash:
        self = cls(np.empty(0, np.uint64))
        sizes = x["sizes"]
        self.bits = np.split(np.unpackbits(x["bits"])[: sizes.sum()].astype(bool), np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.rest = x["rest"]
        self.base = np.concatenate([[0], np.cumsum([int(b.sum()) for b in self.bits])]).astype(np.int64)
        self.rank = [np.cumsum(b) - 1 for b in self.bits]
        self.size = int(self.base[-1]) + len(self.rest)
        return self


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ GOLD) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class StoreOptions:
    """end: id appended to each document. part: keys of an index part, about."""

    vocabulary: str = "byte_bpe_50k.json"
    end: int = 2
    part: int = 65_536


@dataclass
class TokenStore:
    """A written store: where it and its tokenizer lie, its rows (doc_id, copy, shard, file, offset, n) and its index (part, file)."""

    uri: str
    path: str
    dtype: str
    parts: int
    rows: DataFrame
    index: DataFrame
    shards: DataFrame

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, shard, file, offset, n) of `keys` (doc_id, copy), through the index; absent keys are left out.

        A key that was never written passes for one that was with a chance of 2^-32.
        """
        uri = self.uri
        asked = keys.select("doc_id", "copy", _hashed(F.col("doc_id"), F.col("copy")).alias("key")).withColumn("part", _part(self.parts))

        def find(key, pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[pdf["file"].notna()]
            if not len(own):
                return pd.DataFrame({"key": [], "shard": [], "offset": [], "n": []}).astype("int64")
            fs, path = filesystem(uri)
            with fs.open_input_file(f"{path}/{own['file'].iloc[0]}") as f:
                x = np.load(pa.BufferReader(f.read()), allow_pickle=False)
                k = pdf.loc[pdf["file"].isna(), "key"].to_numpy(np.int64).view(np.uint64)
                slot = PerfectHash.unpack(x).slot(k)
                ok = slot >= 0
                ok[ok] = x["fingerprint"][slot[ok]] == fingerprint(k[ok])
                slot = slot[ok]
                return pd.DataFrame({"key": k[ok].view(np.int64), "shard": x["shard"][slot], "offset": x["offset"][slot], "n": x["n"][slot]})

        both = asked.select("part", "key", F.lit(None).cast("string").alias("file")).union(self.index.select("part", F.lit(0).cast("long"), "file"))
        found = both.groupBy("part").applyInPandas(find, "key long, shard long, offset long, n long").dropDuplicates(["key"])
        return asked.join(found, "key").join(F.broadcast(self.shards.select("shard", "file")), "shard").select("doc_id", "copy", "shard", "file", "offset", "n")

    def read(self, found: DataFrame) -> DataFrame:
        """`found` (as from lookup) and ids (binary, as stored), read from the shards in order of offset."""
        return self.read_as(found, "ids binary", lambda ids: pa.array(ids, pa.binary()))

    def read_as(self, found: DataFrame, column: str, make: Callable[[list[bytes]], pa.Array]) -> DataFrame:
        """`found` and a column, declared as in SQL, that `make` makes of the stored ids of many rows in the task that reads them."""
        uri, width, path = self.uri, np.dtype(self.dtype).itemsize, self.path
        name_of = column.split()[0]

        @tidy
        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Workers that encoded before are used again.
            release(path)
            fs, folder = filesystem(uri)
            name, f, held, at = None, None, b"", 0
            for batch in record_slices(batches):
                out = []
                for file, offset, n in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["n"].to_pylist(), strict=True):
                    if file != name:
                        f, name, held, at = fs.open_input_file(f"{folder}/{file}"), file, b"", 0
                    a, size = offset * width, n * width
                    if a < at or a + size > at + len(held):
                        f.seek(a)
                        held, at = f.read(max(BLOCK, size)), a
                    out.append(held[a - at : a - at + size])
                yield pa.RecordBatch.from_arrays([*batch.columns, make(out)], names=[*batch.schema.names, name_of])

        dealt = found.repartition(partitions(found.sparkSession), "file").sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(ranges, f"{', '.join(f'{c} {t}' for c, t in found.dtypes)}, {column}")


def _hashed(doc_id, copy):
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, nulls, copies in batches:
            yield pd.Series(key_hash(ids.to_numpy(), nulls.to_numpy(), copies.to_numpy()).view(np.int64))

    return F.pandas_udf(run, "long")(F.coalesce(doc_id, F.lit(0)).cast("long"), doc_id.isNull(), copy)


def _part(parts: int):
    return F.pmod(F.col("key"), F.lit(parts)).cast("int")


def write_store(docs: DataFrame, options: StoreOptions = StoreOptions(), shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode every text, write shards and index to a new folder in the shared storage, and describe them."""
    spark: SparkSession = docs.sparkSession
    uri, path = new_path(spark, "tokens"), vocabulary(options.vocabulary)
    if "://" not in uri and uri.startswith("file:"):
        uri = uri.replace("file:", "file://", 1)
    end = options.end
    dtype = np.dtype(tokenizers_cached(path).dtype).newbyteorder("<").str

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(uri)
        fs.create_dir(folder, recursive=True)
        encode, last = tokenizers_cached(path), np.array([end], dtype).tobytes()
        shard = TaskContext.get().partitionId()
        file, f, at, before, copy = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin", None, 0, object(), 0
        for batch in record_slices(batches):
            ids, copies, offsets, sizes = batch["doc_id"].to_pylist(), [], [], []
            f = f or fs.open_output_stream(f"{folder}/{file}")
            for doc, text in zip(ids, batch["text"].to_pylist(), strict=True):
                raw = encode(text) + last
                f.write(raw)
                copy = copy + 1 if doc == before else 0
                before, n = doc, len(raw) // len(last)
                copies.append(copy)
                offsets.append(at)
                sizes.append(n)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.int32()), pa.array([shard] * len(ids), pa.int32()), pa.array([file] * len(ids)), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "copy", "shard", "file", "offset", "n"])
        if f:
            f.close()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = own.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = cut(dealt.mapInArrow(write, "doc_id long, copy int, shard int, file string, offset long, n long"), "rows")
    each = rows.groupBy("shard", "file").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = cut(each.withColumn("base", base), "shards")

    parts = max(partitions(spark), (rows.count() + options.part - 1) // options.part)

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        release(path)
        k = pdf["key"].to_numpy(np.int64).view(np.uint64)
        mph = PerfectHash(k)
        slot = mph.slot(k)
        out = {"fingerprint": np.zeros(mph.size, np.uint32), "shard": np.zeros(mph.size, np.int32), "offset": np.zeros(mph.size, np.int64), "n": np.zeros(mph.size, np.int64)}
        out["fingerprint"][slot] = fingerprint(k)
        for c in ("shard", "offset", "n"):
            out[c][slot] = pdf[c].to_numpy()
        fs, folder = filesystem(uri)
        file = f"index-{int(key[0]):06d}-{uuid.uuid4().hex}.npz"
        sink = pa.BufferOutputStream()
        np.savez(sink, **mph.pack(), **out)
        with fs.open_output_stream(f"{folder}/{file}") as f:
            f.write(sink.getvalue())
        return pd.DataFrame({"part": [int(key[0])], "file": [file], "keys": [len(k)]})

    keyed = rows.select(_hashed(F.col("doc_id"), F.col("copy")).alias("key"), "shard", "offset", "n").withColumn("part", _part(parts))
    index = cut(keyed.groupBy("part").applyInPandas(build, "part int, file string, keys long"), "index")
    return TokenStore(uri, path, dtype, parts, rows, index, each)


def digests(docs: DataFrame, options: StoreOptions = StoreOptions()) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): writes a store and reads every document back through the index."""
    bound_batches(docs.sparkSession)
    store = write_store(docs, options)
    dtype = store.dtype

    def crc(ids: list[bytes]) -> pa.Array:
        return pa.array([zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in ids], pa.int64())

    # The ids go no further than the task that reads them.
    got = store.read_as(store.lookup(store.rows.select("doc_id", "copy")), "ids_crc32 long", crc)
    summed = got.select("doc_id", "shard", "offset", F.col("n").alias("n_tokens"), "ids_crc32")
    return summed.join(F.broadcast(store.shards.select("shard", "base")), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
