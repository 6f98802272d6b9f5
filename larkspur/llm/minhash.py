"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A plain LSH index of L tables needs L keys of k minhashes. Here each document has two small collections of m half
keys (k/2 minhashes each); table (i, j) has the key (left i, right j), so 2m half keys make m * m tables, and about
the square root of the minhashes is computed. Two documents are candidates if they agree on some left and some right
half key. Tables are not written out: rows are dealt by left half key, and the right ones are compared inside.

Scale and skew: equal shingle sets are one class and only its smallest id goes on. A group of a left half key with
more than `block` rows is dealt as pairs of blocks over many tasks. A pair is looked at only in the first group that
it shares, and only if set sizes and a histogram of the sets' hashes (an exact upper bound of the intersection) allow
a link. Links are confirmed in two rounds: first few for each document, then all candidates whose ends are still in
different components. So no link between components is lost, and not all pairs of a group are emitted.

Edge cases: a text without words has size 0 and links with nothing; with fewer words than a shingle the sequence is
one shingle; a null id links with nothing, has a null component and is kept. Rows that share an id keep their own sets
and links but are in one component. Ties go to the smallest id. Very long texts are one row of one task; minhashes
take their shingles in parts. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, complete_groups, connected_components, cut, fresh, partitions, slices, split_by, tidy
from .words import hash_texts, mix, rolling


@dataclass(frozen=True)
class LinkOptions:
    """Link when 100 * intersection >= percent * union. missed: most of the pairs at exactly that likeness that no table may hold."""

    percent: int = 85
    words: int = 5
    missed: float = 0.002
    block: int = 512
    bins: int = 256

    @property
    def half(self) -> int:
        """Minhashes of a half key: as many as two sets at the threshold share with a chance of 0.4, from 2 to 8."""
        return 8 if self.percent >= 100 else min(8, max(2, int(math.log(0.4) / math.log(self.percent / 100))))

    @property
    def side(self) -> int:
        """Half keys of each collection: the fewest with which a pair at the threshold is missed no more often than `missed`."""
        if self.percent >= 100:
            return 1
        shared = (self.percent / 100) ** self.half
        # Both collections must hold a shared key: missed = 1 - (1 - (1 - shared) ** side) ** 2.
        return math.ceil(math.log(1 - math.sqrt(1 - self.missed)) / math.log(1 - shared))


def shingle_sets(texts: Iterable[str | None], words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; A-Z are lower-cased."""
    h, begin = hash_texts(texts, lower=True)
    runs, out = rolling(h, words), []
    for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(np.unique(runs[a : z - words + 1]))
        else:
            out.append(mix(rolling(h[a:z], z - a) + np.uint64(z - a)) if z > a else np.empty(0, np.uint64))
    return out


class Hashes:
    """The minhash functions of both collections, from a fixed seed."""

    def __init__(self, options: LinkOptions):
        n = 2 * options.side * options.half
        self.options = options
        seeds = np.arange(1, 2 * n + 1, dtype=np.uint64)
        self.xor, self.times = mix(seeds[:n])[:, None], mix(seeds[n:])[:, None] | np.uint64(1)

    def half_keys(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.xor), np.iinfo(np.uint64).max)
        for a in range(0, len(s), 4096):
            v = (s[None, a : a + 4096] ^ self.xor) * self.times
            np.minimum(low, v.min(axis=1), out=low)
        keys = low.reshape(2 * self.options.side, self.options.half)
        out = np.zeros(len(keys), np.uint64)
        for j in range(self.options.half):
            out = mix(out + keys[:, j])
        return out

    def histogram(self, s: np.ndarray) -> np.ndarray:
        """Elements by the low bits of their hashes; 255 means that many or more."""
        return np.minimum(np.bincount((s % np.uint64(self.options.bins)).astype(np.int64), minlength=self.options.bins), 255).astype(np.uint8)


def signatures(text: Column, options: LinkOptions) -> Column:
    """struct(n, set_hash, left, right, bins) of a text column; all but n are null for an empty set."""

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = Hashes(options)
        for texts in slices(batches):
            rows = []
            for s in shingle_sets(texts, options.words):
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                keys = hashes.half_keys(s)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), keys[: options.side].view(np.int64), (keys[options.side :] >> np.uint64(32)).astype(np.uint32).tobytes(), hashes.histogram(s).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "set_hash", "left", "right", "bins"])

    return F.pandas_udf(run, "n long, set_hash binary, left array<long>, right binary, bins binary")(text)


def candidates(rows: DataFrame, options: LinkOptions, sparse: bool) -> DataFrame:
    """Candidate pairs (a < b) of `rows`: t, key, cnt, id, n, left, right, bins, component.

    sparse: of each document and group only the likeliest partner and the first one. Otherwise every candidate whose
    ends are in different components.
    """
    split = F.ceil(F.col("cnt") / options.block).cast("int")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("id"), split).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), split - 1)))
    dealt = dealt.withColumn("b1", F.least("mine", "other")).withColumn("b2", F.greatest("mine", "other")).drop("other", "cnt")
    keys = ["key", "t", "b1", "b2"]

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in complete_groups(batches, keys, 4096):
            edge = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                edge[1:] |= v[1:] != v[:-1]
            group = np.cumsum(edge)
            t, n, ids, mine = pdf["t"].to_numpy(), pdf["n"].to_numpy(), pdf["id"].to_numpy(), pdf["mine"].to_numpy()
            one_block, component = (pdf["b1"] == pdf["b2"]).to_numpy(), pdf["component"].to_numpy()
            left = np.stack(pdf["left"].to_list())
            right = np.frombuffer(b"".join(pdf["right"]), np.uint32).reshape(len(pdf), -1)
            bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), -1)
            full = bins.max(axis=1) == 255
            found = []
            for d in range(1, len(pdf)):
                i = np.flatnonzero(group[:-d] == group[d:])
                if not len(i):
                    break
                j = i + d
                ok = (one_block[i] | (mine[i] != mine[j])) & (100 * np.minimum(n[i], n[j]) >= options.percent * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
                if not sparse:
                    ok &= component[i] != component[j]
                i, j = i[ok], j[ok]
                same = left[i] == left[j]
                ok = (same.argmax(axis=1) == t[i]) & (right[i] == right[j]).any(axis=1)
                i, j = i[ok], j[ok]
                if len(i):
                    most = np.minimum(bins[i], bins[j]).sum(axis=1, dtype=np.int64)
                    ok = ((100 + options.percent) * most >= options.percent * (n[i] + n[j])) | full[i] | full[j]
                    i, j, most = i[ok], j[ok], most[ok]
                    found.append(np.stack([i, j, 1_000_000 * most // (n[i] + n[j])]))
            if not found:
                continue
            i, j, near = np.concatenate(found, axis=1)
            if sparse:
                who, with_, near = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([near, near])
                take = []
                for order in (np.lexsort((ids[with_], -near, who)), np.lexsort((ids[with_], who))):
                    take.append(order[np.unique(who[order], return_index=True)[1]])
                take = np.unique(np.concatenate(take))
                i, j = who[take], with_[take]
            pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1), axis=0)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "id").mapInPandas(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, options: LinkOptions) -> DataFrame:
    """The pairs whose full sets meet the threshold."""

    @tidy
    def enough(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                out.append(100 * both >= options.percent * (len(x) + len(y) - both))
            yield pd.Series(out, dtype=bool)

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return joined.where(F.pandas_udf(enough, "boolean")("x", "y")).select("a", "b")


def near_duplicates(docs: DataFrame, options: LinkOptions = LinkOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        return cut(_groups(own, options, scratch), "groups")


def _groups(own: DataFrame, options: LinkOptions, scratch: Scratch) -> DataFrame:
    signed = cut(own.select("id", signatures(F.col("text"), options).alias("s")).select("id", "s.*"), "signatures", scratch)
    # A class is a set; its number is made once and read from its table ever after. Rows of a class have equal signatures.
    usable = signed.where("n > 0 and id is not null")
    classes = usable.groupBy("set_hash").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "left", "right", "bins")])
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes", scratch)
    signs = classes.select("id", "n", "left", "right", "bins")

    keyed = classes.select("id", F.posexplode("left").alias("t", "key"))
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    members = cut(keyed.join(shared, ["t", "key"]), "members", scratch)
    wanted = cut(members.select("id").distinct().join(classes.select("id", "rep", "set_hash"), "id").select(F.col("id").alias("class"), "set_hash", F.col("rep").alias("id")), "wanted", scratch)
    rows = members.join(signs, "id")

    @tidy
    def as_sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in slices(batches):
            sets = shingle_sets(texts, options.words)
            yield pd.DataFrame({"set": [s.tobytes() for s in sets], "hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]})

    # Other rows may share the id of a class; the digest tells which of them has its set.
    texts = split_by(own.where("id is not null"), wanted, "id")[0].join(wanted, "id")
    sets = texts.select("class", "set_hash", F.pandas_udf(as_sets, "set binary, hash binary")("text").alias("s"))
    sets = cut(sets.where("s.hash = set_hash").select(F.col("class").alias("id"), "s.set").dropDuplicates(["id"]), "sets", scratch)

    first = cut(candidates(rows.withColumn("component", F.col("id")), options, sparse=True).distinct(), "pairs", scratch)
    links = cut(confirmed(first, sets, options), "links", scratch)
    part = connected_components(links, scratch)
    labelled = rows.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    second = candidates(labelled, options, sparse=False).join(first, ["a", "b"], "left_anti")
    more = cut(confirmed(second, sets, options), "links", scratch)
    # Classes of rows that share an id are in one component.
    same = usable.groupBy("id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select(F.col("id").alias("doc"))
    same = usable.select(F.col("id").alias("doc"), "set_hash").join(same, "doc").join(classes.select("set_hash", "id"), "set_hash").select("doc", "id")
    same = same.join(same.groupBy("doc").agg(F.min("id").alias("low")), "doc").select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b")
    more = cut(more.union(same), "links", scratch)
    if not more.isEmpty():
        # What is linked already is a star each.
        part = connected_components(more.union(part.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch)
    # Components are named by the smallest id of their classes.
    named = classes.select("set_hash", "rep", "id").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = cut(named.select("set_hash", "rep", "component"), "named", scratch)
    least = named.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("c")).where("c > 1").select("component", "least")
    named = named.join(least, "component", "left").select("set_hash", F.coalesce("least", "rep").alias("component"))
    out = signed.select("id", "n", F.when(F.col("id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(named, "set_hash", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """`docs` with the smallest id of each group only; rows without an id stay."""
    bound_batches(docs.sparkSession)
    gone = near_duplicates(docs.select("doc_id", "text"), options).where("not kept").select("doc_id").distinct()
    # Hashes of keys are compared, so both sides have one type.
    (key,) = fresh(docs, "_doc")
    maybe, sure = split_by(docs.withColumn(key, F.col("doc_id").cast("long")), gone.withColumnRenamed("doc_id", key), key)
    return sure.drop(key).union(maybe.join(gone.withColumnRenamed("doc_id", key), key, "left_anti").select(*docs.columns))


# The same result in SQL: all shingles joined, components by recursion. For small tables.
ORACLE = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), each_word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM words WHERE len(w) >= 5
), runs AS (
  SELECT doc_id, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p AS e FROM each_word WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), elements AS MATERIALIZED (
  SELECT DISTINCT doc_id, e FROM runs WHERE e IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM elements x JOIN elements y ON x.e = y.e AND x.doc_id < y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT ends.b, reach.c FROM reach JOIN ends ON ends.a = reach.doc_id
), least_of AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN sizes USING (doc_id)
"""
