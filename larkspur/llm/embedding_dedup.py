"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables, reranked with the vectors.

A rotation of the centred vectors is learnt so that signs lose little (principal axes, then alternating codes and
Procrustes steps); signs are the bits of a code. The code is cut into substrings and each is the key of one table,
together with the label. More rotations, from other starts, make the code longer and give more tables. The bits of a
key follow the number of vectors, so that buckets keep their size. The number of tables is measured: sampled vectors
that had no part in the fit get partners at the threshold, and tables are added until at least `recall` of these pairs
agree in one.

Retrieval has two steps. First only codes are dealt to buckets; pairs whose Hamming distance is over that of every
measured pair (with a margin) are passed over, and each pair is looked at in the first table that it shares. Then the
vectors that have a partner left in a bucket are fetched for it and compared by cosine in double precision.

Scale and skew: equal vectors of a label are one class with a count. A bucket of more than `block` vectors is dealt as
pairs of blocks over many tasks. A task returns a count of links and the smallest class reached for each vector of a
bucket, never pairs. Neighbours of a key are not probed: a probe is one more row to shuffle, like one more table, but
brings no more pairs together than a table does (at 30 bits 53 tables with 31 probes each do what 285 tables do).

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, that have no label or no id,
link with nothing; their component is their own id. Vectors of each dimension are indexed apart; one index for each
dimension is on the driver. Each of the rows that share an id has its own links; their components are one. Ties have
no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, complete_groups, connected_components, cut, partitions


@dataclass(frozen=True)
class VectorOptions:
    """threshold: least cosine of a link. recall: share of pairs at the threshold that must share a table. sample: vectors that the rotations are fitted on, at most twice as many. bucket: vectors of a label for each possible key; under 1 few unlike vectors share a bucket. most_bits: of a key. block: vectors of a bucket that one task compares. rounds: of the fit. margin: of the Hamming bound, as a share of it."""

    threshold: float = 0.93
    recall: float = 0.998
    sample: int = 4096
    bucket: float = 0.1
    most_bits: int = 48
    block: int = 1024
    rounds: int = 20
    margin: float = 0.1


@dataclass
class Index:
    """mean, and for each rotation a matrix of axes; substrings of `bits` bits of each rotation's code are keys. reach: Hamming distance of all keys together that pairs at the threshold keep within."""

    mean: np.ndarray
    axes: list[np.ndarray]
    bits: int
    tables: int
    reach: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """int64 keys of each vector (row) and table."""
        return np.concatenate([_keys(unit - self.mean, axes, self.bits) for axes in self.axes], axis=1)[:, : self.tables]


def _keys(x: np.ndarray, axes: np.ndarray, bits: int) -> np.ndarray:
    code = (x @ axes > 0).astype(np.int64)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    return np.stack([code[:, a : a + bits] @ weights for a in range(0, code.shape[1] - bits + 1, bits)], axis=1)


def partners(sample: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector one at a cosine of `threshold` in a random direction."""
    w = np.random.default_rng(7).standard_normal(sample.shape)
    w -= (w * sample).sum(axis=1, keepdims=True) * sample
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    v = threshold * sample + math.sqrt(1 - threshold**2) * np.divide(w, norm, out=np.zeros_like(w), where=norm > 1e-9)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


# Vectors that a fit has at least; random directions make up for missing ones.
LEAST_SAMPLE = 512


def learn(sample: np.ndarray, labelled: int, options: VectorOptions) -> Index:
    """Fit rotations on unit vectors. labelled: vectors of the largest label, which sets the bits of a key."""
    dim = sample.shape[1]
    if len(sample) < LEAST_SAMPLE:
        more = np.random.default_rng(11).standard_normal((LEAST_SAMPLE - len(sample), dim))
        sample = np.concatenate([sample, more / np.linalg.norm(more, axis=1, keepdims=True)])
    bits = int(np.clip(round(math.log2(max(2.0, labelled / options.bucket))), min(4, dim), min(dim, options.most_bits)))
    mean = sample.mean(axis=0)
    # Half of the sample is fitted; pairs are made of the other half, for which the fit isn't flattering.
    fitted, x, y = sample[::2] - mean, sample[1::2] - mean, partners(sample[1::2], options.threshold) - mean
    principal = np.linalg.eigh(fitted.T @ fitted + 1e-9 * np.eye(dim))[1][:, ::-1]
    v = fitted @ principal
    axes, tables, apart, rounds = [], 0, np.zeros(len(x), np.int64), options.rounds
    missed = np.ones(len(x), bool)
    while missed.mean() > 1 - options.recall:
        k, before = len(axes), int(missed.sum())
        turn = np.linalg.qr(np.random.default_rng(k).standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (left @ right).T
        # Substrings get bits at random, so none holds only the weak axes.
        axes.append((principal @ turn)[:, np.random.default_rng(1000 + k).permutation(dim)])
        a, b = _keys(x, axes[-1], bits), _keys(y, axes[-1], bits)
        for t in range(a.shape[1]):
            if missed.mean() <= 1 - options.recall:
                break
            missed &= a[:, t] != b[:, t]
            apart += np.bitwise_count(a[:, t] ^ b[:, t])
            tables += 1
        # In few dimensions fits end at the same rotation again and again; a random one is taken after one that brought nothing new.
        rounds = 0 if missed.sum() > 0.98 * before else options.rounds
    return Index(mean, axes, bits, tables, math.ceil((1 + options.margin) * int(apart.max(initial=0))) + 1)


def units(rows: DataFrame) -> DataFrame:
    """(id, label, dim, unit) of every row: unit is the vector at length 1, as doubles in a binary, or null if it links with nothing."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            out = []
            for v in many:
                v = None if v is None else np.asarray(v, np.float64)
                norm = 0.0 if v is None or not len(v) else float(np.sqrt(v @ v))
                out.append((v / norm).tobytes() if norm > 0 and np.isfinite(norm) and np.isfinite(v).all() else None)
            yield pd.Series(out, dtype=object)

    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    unit = F.pandas_udf(run, "binary")(F.when(usable, F.col("embedding")).cast("array<double>"))
    return rows.select("id", "label", unit.alias("unit")).withColumn("dim", (F.octet_length("unit") / 8).cast("int"))


BUCKET = ["dim", "label", "t", "key"]


def _in_buckets(rows: DataFrame, options: VectorOptions, judge, schema: str) -> DataFrame:
    """`judge(pdf, group, own)` over frames of whole buckets (or pairs of their blocks) of `rows` (BUCKET, cnt, id, keys, ...).

    A frame has one dimension. group: number of each row's bucket. own: of row numbers i and j, whether the pair belongs
    to this pair of blocks.
    """
    split = F.ceil(F.col("cnt") / options.block).cast("int")
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("id"), split).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), split - 1)))
    dealt = dealt.withColumn("b1", F.least("mine", "other")).withColumn("b2", F.greatest("mine", "other")).drop("other", "cnt")
    names = [*BUCKET, "b1", "b2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for many in complete_groups(batches, names, 4096):
            for _, pdf in many.groupby("dim", sort=False):
                edge = np.zeros(len(pdf), bool)
                for k in names:
                    v = pdf[k].to_numpy()
                    edge[1:] |= v[1:] != v[:-1]
                one, mine = (pdf["b1"] == pdf["b2"]).to_numpy(), pdf["mine"].to_numpy()
                got = judge(pdf, np.cumsum(edge), lambda i, j, one=one, mine=mine: one[i] | (mine[i] != mine[j]))
                if got is not None:
                    yield got

    return dealt.repartition(partitions(rows.sparkSession), *names).sortWithinPartitions(*names, "id").mapInPandas(run, schema)


def retrieved(rows: DataFrame, indexes: dict[int, Index], options: VectorOptions) -> DataFrame:
    """(BUCKET, id) of vectors that have a partner within reach, in the first bucket that they share; by codes alone."""
    reach = {dim: index.reach for dim, index in indexes.items()}

    def judge(pdf: pd.DataFrame, group: np.ndarray, own) -> pd.DataFrame | None:
        keys, t, far = np.stack(pdf["keys"].to_list()), pdf["t"].to_numpy(), reach[int(pdf["dim"].iloc[0])]
        some = np.zeros(len(pdf), bool)
        for d in range(1, len(pdf)):
            i = np.flatnonzero(group[:-d] == group[d:])
            if not len(i):
                break
            i = i[own(i, i + d)]
            apart = keys[i] ^ keys[i + d]
            # In table t their keys agree; in no table before it do they.
            i = i[((apart == 0).argmax(axis=1) == t[i]) & (np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= far)]
            some[i] = some[i + d] = True
        return pdf.loc[some, [*BUCKET, "id"]] if some.any() else None

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _in_buckets(rows, options, judge, ", ".join(f"`{c}` {kinds[c]}" for c in [*BUCKET, "id"]))


def links_in_buckets(rows: DataFrame, options: VectorOptions) -> DataFrame:
    """(id, links, low) of `rows` (BUCKET, cnt, id, times, unit, keys), one for each bucket in which id links."""
    threshold = options.threshold

    def judge(pdf: pd.DataFrame, group: np.ndarray, own) -> pd.DataFrame | None:
        unit = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        keys, ids, times, t = np.stack(pdf["keys"].to_list()), *(pdf[c].to_numpy() for c in ("id", "times", "t"))
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(pdf))
        found = []
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if z - a < 2:
                continue
            at = np.arange(a, z)
            near = (unit[a:z] @ unit[a:z].T >= threshold) & own(at[:, None], at[None])
            np.fill_diagonal(near, False)
            some = near.any(axis=1)
            if not some.any():
                continue
            # A pair counts in the first table that it shares.
            first = near.copy()
            for k in range(int(t[a])):
                if not first.any():
                    break
                first &= keys[a:z, k, None] != keys[None, a:z, k]
            links, low = first @ times[a:z], ids[a:z]
            while True:
                was = low
                low = np.minimum(was, np.where(near, was[None, :], was[:, None]).min(axis=1))
                if (low == was).all():
                    break
            found.append((ids[a:z][some], links[some], low[some]))
        return pd.DataFrame({c: np.concatenate([x[k] for x in found]) for k, c in enumerate(("id", "links", "low"))}) if found else None

    return _in_buckets(rows, options, judge, "id long, links long, low long")


def near_vectors(table: DataFrame, options: VectorOptions = VectorOptions()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `table` (vec_id, embedding, label)."""
    own = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding"), F.col("label"))
    with Scratch(table.sparkSession) as scratch:
        return cut(_linked(own, options, scratch), "vectors")


def _indexes(usable: DataFrame, options: VectorOptions) -> dict[int, Index]:
    """An index for each dimension, fitted on a sample by a hash of the ids."""
    sizes = usable.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    if not sizes:
        return {}
    bound = F.create_map(*[x for r in sizes for x in (F.lit(r["dim"]), F.lit(-float(2**63) + float(2**64) * min(1.0, options.sample / r["n"])))])
    drawn: dict[int, list[np.ndarray]] = {r["dim"]: [] for r in sizes}
    for r in usable.where(F.xxhash64("id").cast("double") <= F.element_at(bound, F.col("dim"))).select("dim", "unit").limit(2 * options.sample * len(sizes)).collect():
        drawn[r["dim"]].append(np.frombuffer(r["unit"], np.float64))
    return {r["dim"]: learn(np.array(drawn[r["dim"]]).reshape(-1, r["dim"]), r["most"], options) for r in sizes}


def _linked(own: DataFrame, options: VectorOptions, scratch: Scratch) -> DataFrame:
    every = cut(units(own), "units", scratch)
    usable = every.where("unit is not null")
    indexes = _indexes(usable, options)

    def keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for dims, many in batches:
            out = np.empty(len(many), object)
            for dim in dims.unique().tolist():
                at = np.flatnonzero((dims == dim).to_numpy())
                unit = np.frombuffer(b"".join(many.iloc[at]), np.float64).reshape(len(at), dim)
                for i, k in zip(at.tolist(), indexes[dim].keys(unit).astype(narrow), strict=True):
                    out[i] = k
            yield pd.Series(out)

    # Keys travel with each bucket's rows, so they are as narrow as their bits allow.
    narrow, kind = (np.int32, "int") if all(i.bits < 32 for i in indexes.values()) else (np.int64, "long")
    # Equal vectors of a label are one class. Its number is made once and read from its table ever after.
    classes = usable.groupBy("label", "dim", "unit").agg(F.min("id").alias("rep"), F.count("*").alias("times"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("keys", F.pandas_udf(keys, f"array<{kind}>")("dim", "unit")), "codes", scratch)
    codes = classes.select("id", "keys")
    keyed = classes.select("id", "dim", "label", F.posexplode("keys").alias("t", "key"))
    count = lambda rows: rows.groupBy(*BUCKET).agg(F.count("*").alias("cnt")).where("cnt > 1")
    near = cut(retrieved(keyed.join(count(keyed), BUCKET).join(codes, "id"), indexes, options).distinct(), "retrieved", scratch)
    found = links_in_buckets(near.join(count(near), BUCKET).join(classes.select("id", "times", "unit", "keys"), "id"), options)
    found = cut(found, "links", scratch)

    # Classes of rows that share an id are in one component.
    named = usable.join(classes.select("label", "unit", F.col("id").alias("class")), ["label", "unit"]).select(F.col("id").alias("vec"), "class")
    several = named.groupBy("vec").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    same = named.join(several, "vec").where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    part = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).union(same), scratch)
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    out = classes.join(counted, "id", "left").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = cut(out.select("label", "unit", "rep", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), "component"), "named", scratch)
    # Components are named by the smallest id of their classes.
    least = out.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("c")).where("c > 1").select("component", "least")
    out = out.join(least, "component", "left").select("label", "unit", "links", F.coalesce("least", "rep").alias("component"))
    done = every.select("id", "label", "unit").join(out, ["label", "unit"], "left")
    component = F.coalesce("component", "id")
    return done.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


# All pairs of a label, for small tables.
ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT pairs.b, reach.c FROM reach JOIN pairs ON pairs.a = reach.vec_id
), least_of AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id
), counted AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least_of LEFT JOIN counted USING (vec_id)
"""
