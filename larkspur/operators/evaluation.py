"""Operators over experiment records: resampling, nulls, centroids, concentration, splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import stats

SEED = 20260819
# Draws of the permutation null that one task makes for a cell.
DRAWS_OF_A_TASK = 500


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of columns: the same on every executor and in every attempt."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def cluster_bootstrap(cells: DataFrame, by: list[str], cluster: str, side: str, k: str, n: str, draws: int = 1000, seed: int = SEED) -> DataFrame:
    """by, diff, low, high, used: the difference of rates between sides True and False, and its 95 % interval.

    cells: by, cluster, side (boolean), k of n. Each draw gives each cluster a Poisson weight, which is drawing clusters
    with replacement without gathering them; a cluster's weights come from a generator of its own, seeded by its hash, so
    they are the same in every task and attempt. A task adds up arrays of weighted counts, one for each cell and block of
    draws, so no row is multiplied. Draws with an empty side are skipped.
    """
    sides = cells.groupBy(*by, cluster).agg(*[F.sum(F.when(F.col(side) == s, F.col(c)).otherwise(0)).cast("double").alias(f"{c}{int(s)}") for s in (True, False) for c in (k, n)])
    counts = [f"{c}{s}" for s in "10" for c in (k, n)]
    own = sides.select(*by, F.xxhash64(F.col(cluster).cast("string")).alias("_cluster"), F.array(*counts).alias("_counts"))
    kinds = [cells.schema[c] for c in by]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = [(*key, block, sums[:, a : a + DRAWS_OF_A_TASK].tobytes()) for key, sums in held.items() for block, a in enumerate(range(0, draws, DRAWS_OF_A_TASK))]
            return pd.DataFrame(out, columns=[*by, "_block", "_sums"])

        for pdf in batches:
            for *key, h, counts in pdf.itertuples(index=False):
                weight = np.random.default_rng([seed, h % 2**64]).poisson(1.0, draws)
                sums = held.setdefault(tuple(key), np.zeros((4, draws)))
                sums += np.asarray(counts, np.float64)[:, None] * weight
                if len(held) > 32:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    def differences(pdf: pd.DataFrame) -> pd.DataFrame:
        k1, n1, k0, n0 = sum(np.frombuffer(x).reshape(4, -1) for x in pdf["_sums"])
        ok = (n1 > 0) & (n0 > 0)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "_d": [k1[ok] / n1[ok] - k0[ok] / n0[ok]]})

    sums = own.mapInPandas(add, T.StructType([*kinds, T.StructField("_block", T.IntegerType()), T.StructField("_sums", T.BinaryType())]))
    diffs = sums.groupBy(*by, "_block").applyInPandas(differences, T.StructType([*kinds, T.StructField("_d", T.ArrayType(T.DoubleType()))]))
    rate = lambda side: F.sum(f"{k}{side}") / F.nullif(F.sum(f"{n}{side}"), F.lit(0.0))
    observed = sides.groupBy(*by).agg((rate(1) - rate(0)).alias("diff"))
    ends = diffs.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("_d"))).alias("s")).where(F.size("s") > 0)
    at = lambda q: F.element_at("s", F.floor(F.lit(q) * (F.size("s") - 1)).cast("int") + 1)
    ends = ends.select(*by, at(0.025).alias("low"), at(0.975).alias("high"), F.size("s").cast("long").alias("used"))
    return observed.join(ends, by, "left").select(*by, "diff", "low", "high", F.coalesce("used", F.lit(0).cast("long")).alias("used"))


# Units for each class of equal units up to which a draw deals every unit by itself.
UNITS_OF_A_CLASS = 8


def dealt_rates(truths: np.ndarray, units_of_truth: np.ndarray, answers: list[dict[int, int]], units_of_class: np.ndarray, draws: int, seed: list[int]) -> np.ndarray:
    """Hit rates when truths are dealt anew over units.

    units_of_truth: how many units have each of `truths` (-1: none). answers: of each class of units how often a unit
    gives each answer; units_of_class: how many units the class has. Units of a class are alike, so a draw is a table of
    classes by truths with these margins, class after class from a multivariate hypergeometric distribution; where most
    units are a class of their own, they are dealt one by one.
    """
    rng, hits = np.random.default_rng(seed), np.zeros(draws)
    total = sum(n * sum(a.values()) for a, n in zip(answers, units_of_class.tolist(), strict=True))
    value = np.array([[a.get(t, 0) if t >= 0 else 0 for t in truths.tolist()] for a in answers], np.int64)
    if units_of_class.sum() <= UNITS_OF_A_CLASS * len(answers):
        row, dealt = np.repeat(np.arange(len(answers)), units_of_class), np.repeat(np.arange(len(truths)), units_of_truth)
        for d in range(draws):
            hits[d] = value[row, rng.permutation(dealt)].sum()
    else:
        # Classes that answer nothing take whatever truths are left.
        giving = np.flatnonzero(value.any(axis=1))
        for d in range(draws):
            left = units_of_truth.copy()
            for c in giving.tolist():
                got = rng.multivariate_hypergeometric(left, int(units_of_class[c]), method="marginals")
                hits[d] += value[c] @ got
                left -= got
    return hits / max(1, total)


def permutation_null(items: DataFrame, by: list[str], unit: str, truth: str, answer: str, draws: int = 200, seed: int = SEED) -> DataFrame:
    """by, observed, null_mean, low, high, p: answers against truths dealt anew over the units of each cell.

    Spark counts each unit's answers, then the units whose counts are equal, which are one class, and the units of each
    truth. A cell is one row of classes and truths with these counts, however many units it has; blocks of draws spread
    over tasks, each with a generator of its own. A unit with several truths is one unit for each of them. Null answers
    don't count. p = (b + 1) / (m + 1).
    """
    counts = items.groupBy(*by, F.col(unit).alias("_unit"), F.col(truth).alias("_truth"), F.col(answer).alias("_answer")).agg(F.count(answer).alias("_n"))
    observed = counts.groupBy(*by).agg((F.sum(F.when(F.col("_truth") == F.col("_answer"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("observed"))
    text = lambda c: F.col(c).cast("string")
    given = F.array_sort(F.collect_list(F.when(F.col("_answer").isNotNull(), F.struct(text("_answer").alias("a"), F.col("_n").alias("n")))))
    units = counts.groupBy(*by, "_unit", text("_truth").alias("_truth")).agg(given.alias("_given"))
    classes = units.groupBy(*by, "_given").agg(F.count("*").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("_given", "n")).alias("_classes"))
    truths = units.groupBy(*by, "_truth").agg(F.count("*").alias("n")).groupBy(*by).agg(F.collect_list(F.struct("_truth", "n")).alias("_truths"))
    spread = classes.join(truths, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAWS_OF_A_TASK) - 1))))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cell in pdf.itertuples(index=False):
                *key, groups, margin, block = cell
                margin, groups = sorted(margin, key=lambda t: (t["_truth"] is None, t["_truth"] or "")), sorted(groups, key=lambda c: [(g["a"], g["n"]) for g in c["_given"]])
                number = {name: i for i, name in enumerate(dict.fromkeys([t["_truth"] for t in margin if t["_truth"] is not None] + [g["a"] for c in groups for g in c["_given"]]))}
                own = np.array([number[t["_truth"]] if t["_truth"] is not None else -1 for t in margin], np.int64)
                answers = [{number[g["a"]]: int(g["n"]) for g in c["_given"]} for c in groups]
                first = block * DRAWS_OF_A_TASK
                rates = dealt_rates(own, np.array([t["n"] for t in margin], np.int64), answers, np.array([c["n"] for c in groups], np.int64), min(DRAWS_OF_A_TASK, draws - first), [seed, int(block)])
                yield pd.DataFrame({**{c: [v] for c, v in zip(by, key, strict=True)}, "_rates": [rates]})

    kinds = [items.schema[c] for c in by]
    rates = spread.repartition(*by, "_block").mapInPandas(deal, T.StructType([*kinds, T.StructField("_rates", T.ArrayType(T.DoubleType()))]))
    gathered = rates.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("_rates"))).alias("s")).join(observed, by)
    at = lambda i: F.element_at("s", F.greatest(F.lit(1), i).cast("int"))
    m = F.size("s")
    mean, b = F.aggregate("s", F.lit(0.0), lambda x, y: x + y) / m, F.size(F.filter("s", lambda x: x >= F.col("observed")))
    return gathered.select(*by, "observed", mean.alias("null_mean"), at(F.floor(0.025 * m) + 1).alias("low"), at(F.floor(0.975 * m)).alias("high"), ((b + 1) / (m + 1)).alias("p"))


def analytic_null(items: DataFrame, by: list[str], truth: str, answer: str) -> DataFrame:
    """by, chance: the rate of hits if answers and truths were independent."""
    n = items.groupBy(*by).agg(F.count("*").alias("n"))
    a = items.groupBy(*by, F.col(answer).alias("v")).agg(F.count("*").alias("a"))
    t = items.groupBy(*by, F.col(truth).alias("v")).agg(F.count("*").alias("t"))
    both = a.join(t, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("a") * F.col("t")).alias("s"))
    return n.join(both, by, "left").select(*by, (F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))).alias("chance"))


def confusion(items: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, observed, expected agreement of two raters."""
    n = items.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(x) == F.col(y)).cast("double")).alias("observed"))
    return n.join(analytic_null(items, by, x, y), by).withColumnRenamed("chance", "expected")


def domain_split(df: DataFrame, domain: str) -> DataFrame:
    """domain, split: sorted distinct domains, by turns selection and held-out. Domains are few."""
    turn = (F.row_number().over(Window.orderBy(domain)) - 1) % 2
    return df.select(domain).distinct().select(domain, F.when(turn == 0, "selection").otherwise("held-out").alias("split"))


def first_appearance(df: DataFrame, by: list[str], content: str, pos: str, name: str = "idx") -> DataFrame:
    """`df` with a number from 0 for each content within `by`, in the order of first appearance."""
    first = F.min(pos).over(Window.partitionBy(*by, content))
    return df.withColumn("_first", first).withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")) - 1).drop("_first")


def draw(key: Column, seed: int = SEED) -> Column:
    """32 bits of a hash of seed and key: the same in every attempt and in other engines."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long")


def sample_by_hash(df: DataFrame, key: str, share: float, seed: int = SEED) -> DataFrame:
    """A share of the rows by a hash of the key: no sort, the same rows in every attempt."""
    return df.where(draw(F.col(key), seed) < share * 2**32)


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows (all, if there are no more), those with the least hashes of a key: a top-k, not a full sort."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def menu(options: Sequence[str], item: Column, seed: int = SEED) -> Column:
    """The options in an order that the item decides, so that no place is favoured: anyone can make it again from the item."""
    placed = F.array(*[F.struct(draw(F.concat(item.cast("string"), F.lit(f":{o}")), seed).alias("at"), F.lit(o).alias("option")) for o in options])
    return F.transform(F.array_sort(placed), lambda x: x["option"])


def running(df: DataFrame, key: str, order: str, width: int, sums: Mapping[str, Column]) -> DataFrame:
    """`df` and running sums within a key in the order of an integer column.

    Rows are summed within ranges of `width` and each range starts from the sum of those before, so no task sees all rows
    of a key.
    """
    ranged = df.withColumns({"_r": F.floor(F.col(order) / width), **{f"_v_{c}": v for c, v in sums.items()}})
    per = ranged.groupBy(key, "_r").agg(*[F.sum(f"_v_{c}").alias(f"_b_{c}") for c in sums])
    before = Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(key, "_r", *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    own = Window.partitionBy(key, "_r").orderBy(order)
    out = ranged.join(base, [key, "_r"]).withColumns({c: F.sum(f"_v_{c}").over(own) + F.col(f"_b_{c}") for c in sums})
    return out.select(*df.columns, *sums)


def concentrated(tokens: DataFrame, doc: str, domain: str, token: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """token, domain, files, total: tokens in at least `least` files overall and in one domain that has over `share` of them.

    tokens: one row for each token of each document.
    """
    per = tokens.groupBy(token, domain).agg(F.count(doc).alias("files"))
    total = per.groupBy(token).agg(F.sum("files").alias("total"))
    return per.where(F.col("files") >= least).join(total.where(F.col("total") >= least), token).where(F.col("files") > share * F.col("total"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with columns at mean 0 and population deviation 1; a deviation of 0 counts as 1."""
    row = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(row))
    scale = lambda i: F.when(F.col(f"_s{i}") == 0, 1.0).otherwise(F.col(f"_s{i}"))
    return out.select(*[((F.col(c) - F.col(f"_m{columns.index(c)}")) / scale(columns.index(c))).alias(c) if c in columns else F.col(c) for c in df.columns])


def nearest_centroid(vectors: DataFrame, id_col: str, vector: str, label: str, block: int = 4_000_000) -> DataFrame:
    """id, label, nearest: the class with the nearest centroid, where a vector's own class is taken without it.

    Class sums are made by position, so Spark pre-aggregates them. Centroids are dealt to blocks of at most `block` numbers;
    each vector meets each block, and one block is small enough to be broadcast.
    """
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sums = rows.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    classes = sums.groupBy(F.col("label").alias("other")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda e: e["s"]).alias("s"), F.max("n").alias("n"))
    blocks = int((sums.count() + block - 1) // block)
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(max(blocks, 1))))
    dealt = F.broadcast(dealt) if blocks <= 1 else dealt
    paired = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long")))).join(dealt, "block")
    own = F.col("label") == F.col("other")
    centre = F.when(own, F.zip_with("s", "v", lambda s, x: (s - x) / F.nullif(F.col("n") - 1, F.lit(0)))).otherwise(F.transform("s", lambda s: s / F.col("n")))
    far = F.aggregate(F.zip_with("v", centre, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, d: a + d)
    dist = paired.select("id", "label", "other", far.alias("d")).where("d is not null")
    return dist.groupBy("id", "label").agg(F.min_by("other", F.struct("d", "other")).alias("nearest"))


def panel_verdicts(cells: DataFrame, failures: DataFrame, vetoes: DataFrame, domains: DataFrame, blind: str, source: str, draws: int = 1000) -> DataFrame:
    """The verdict of each arm against its strongest attacker: arm, attacker, rate, blind_rate, low, high, spread, gate, verdict.

    cells: arm, attacker, file, k of n. failures: attacker, and k of n answers of all its arms that can't be read. vetoes:
    arms with a veto. domains: arm, and how many domains carry data. The strongest attacker has the highest rate, the first
    of equals by name; an attacker without answers in an arm counts as one of rate 0. Its own blind rate is what the arm is
    compared with, and the interval is that of the difference of these two over their files. Rules in order: an invalid
    gate, too few domains and a wide spread of attackers are inconclusive; then pass and fail. Without a blind arm of that
    attacker nothing is computable. A veto fails an arm, but not where the gate is invalid or domains are too few.
    """
    totals = cells.groupBy("arm", "attacker").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("p", F.col("k") / F.greatest("n", F.lit(1)))
    attackers = totals.select("attacker").distinct()
    controls = attackers.join(totals.where(F.col("arm") == source).select("attacker", "p", "n"), "attacker", "left").join(failures.select("attacker", (F.col("k") / F.nullif(F.col("n"), F.lit(0))).alias("f")), "attacker", "left")
    read, known = F.coalesce("f", F.lit(0.0)) <= stats.PARSE_FAILURES, F.coalesce("n", F.lit(0)) > 0
    state = F.when(~known & read, 1).when((F.coalesce("p", F.lit(0.0)) >= stats.SOURCE_RATE) & read, 0).otherwise(2)
    # One row: how many attackers there are and the worst of their gates.
    panel = controls.agg(F.count("*").alias("n"), F.max(state).alias("worst")).first()
    gate = ("VALID", "NOT EVALUATED", "INVALID")[panel["worst"] or 0]

    judged = totals.where(~F.col("arm").isin(blind, source))
    lowest = F.when(F.count("*") < panel["n"], F.least(F.min("p"), F.lit(0.0))).otherwise(F.min("p"))
    best = judged.groupBy("arm").agg(F.min_by(F.struct("attacker", "p", "n"), F.struct(-F.col("p"), "attacker")).alias("s"), (F.max("p") - lowest).alias("spread"))
    best = best.select("arm", "s.attacker", F.col("s.p").alias("rate"), F.col("s.n").alias("n"), "spread").where("n > 0").drop("n")
    own_blind = totals.where((F.col("arm") == blind) & (F.col("n") > 0)).select("attacker", F.col("p").alias("blind_rate"))
    best = best.join(own_blind, "attacker", "left")
    hit = cells.join(best.select("arm", "attacker"), ["arm", "attacker"]).select("arm", "file", F.lit(True).alias("side"), "k", "n")
    base = cells.where(F.col("arm") == blind).drop("arm").join(best.select("arm", "attacker"), "attacker").select("arm", "file", F.lit(False).alias("side"), "k", "n")
    ends = cluster_bootstrap(hit.unionByName(base), ["arm"], "file", "side", "k", "n", draws).select("arm", "low", "high")
    got = best.join(ends, "arm", "left").join(domains.select("arm", "domains"), "arm", "left").join(vetoes.select("arm").distinct().withColumn("veto", F.lit(True)), "arm", "left")
    short = F.coalesce("domains", F.lit(0)) < stats.LEAST_DOMAINS
    low, high, diff = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0)), F.col("rate") - F.col("blind_rate")
    veto = F.coalesce("veto", F.lit(False)) & F.lit(gate == "VALID") & ~short
    plain = (
        F.when(F.lit(gate != "VALID"), "INCONCLUSIVE: gate " + gate.lower())
        .when(short, "INCONCLUSIVE: domains")
        .when(F.col("spread") > stats.MOST_SPREAD, "INCONCLUSIVE: spread")
        .when((high <= stats.PASS_CI) & (F.col("rate") <= stats.PASS_RATE), "PASS")
        .when((diff >= stats.FAIL_DIFF) & (low > 0), "FAIL")
        .otherwise("INCONCLUSIVE")
    )
    computed = F.when(veto & (plain != "FAIL"), "FAIL: veto").otherwise(plain)
    verdict = F.when(F.col("blind_rate").isNotNull(), computed).when(veto, "FAIL: veto").otherwise("NOT COMPUTABLE")
    return got.select("arm", "attacker", "rate", "blind_rate", "low", "high", "spread", F.lit(gate).alias("gate"), verdict.alias("verdict"))
