"""Joins beyond plain equality: latest prior rows, first matches, coverage, prefixes, nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import shared_folder


def latest_prior(df: DataFrame, key: str, at: Column, trusted: Column, value: Sequence[str], name: str = "prior") -> DataFrame:
    """`df` and a struct of `value` from the latest trusted row of the same key that is strictly before.

    at: an integer, such as a day. Of rows at the same time that with the largest values counts. The frame ends before
    the row's own time, so rows of the same time don't see each other.
    """
    before = Window.partitionBy(key).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_at", at.cast("long"))
    best = F.max(F.when(trusted, F.struct("_at", *value))).over(before)
    return marked.withColumn("_best", best).withColumn(name, F.when(F.col("_best").isNotNull(), F.struct(*[F.col(f"_best.{v}").alias(v) for v in value]))).drop("_at", "_best")


def first_match(claims: DataFrame, rows: DataFrame, keys: Sequence[str], id_col: str, name: str = "matched_id") -> DataFrame:
    """`claims`, the smallest id of the rows that agree in all keys, and a status; claims without one stay."""
    best = rows.groupBy(*keys).agg(F.min(id_col).alias(name))
    out = claims.join(best, list(keys), "left")
    return out.withColumn("match_status", F.when(F.col(name).isNull(), "unmatched").otherwise("matched"))


def coverage(expected: DataFrame, present: DataFrame, keys: Sequence[str], by: Sequence[str], ok: Column) -> DataFrame:
    """Of each group of expected keys: how many are expected, absent, there but not ok, and ok."""
    seen = present.groupBy(*keys).agg(F.max(ok).alias("_ok"))
    out = expected.join(seen, list(keys), "left")
    return out.groupBy(*by).agg(
        F.count("*").alias("expected"),
        F.count_if(F.col("_ok").isNull()).alias("absent"),
        F.count_if(~F.col("_ok")).alias("missing"),
        F.count_if(F.col("_ok")).alias("present"),
    )


def longest_prefix(df: DataFrame, path: str, roots: DataFrame, root: str, sep: str = "/") -> DataFrame:
    """`df` and the longest root that is the path or an ancestor of it: the path's ancestors are the keys of an equi-join."""
    parts = F.split(F.col(path), rf"\Q{sep}\E")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    steps = df.select(path).distinct().select(path, F.explode(above).alias(root))
    best = steps.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return df.join(best, path, "left")


def with_each(df: DataFrame, values: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """`df` times the distinct values of a column, which are few: more than `most` are an error."""
    got = [r[0] for r in values.select(name).distinct().orderBy(name).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{name} has more than {most} values")
    kind = values.schema[name].dataType
    return df.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in got])))


def by_item_prefix(replies: DataFrame, records: DataFrame, reply_id: str, item: str, sep: str = "|") -> DataFrame:
    """`replies` with the record whose item id their own id begins with: the longest beginning that ends before a separator.

    The beginnings are the keys of an equi-join, so nothing is compared pair by pair. Replies without a record go.
    """
    begins = replies.select(reply_id).distinct().select(reply_id, F.col(reply_id).alias("_path"))
    best = longest_prefix(begins, "_path", records.select(item), item, sep).where(F.col(item).isNotNull())
    return replies.join(best.select(reply_id, item), reply_id).join(records, item)


def weighted_tokens(tokens: DataFrame, id_col: str = "id", token_col: str = "token") -> DataFrame:
    """(id, token, df, w, place, rest) of texts with one row for each occurrence of a token.

    w is (1 + ln count) * ln(n / df), scaled to unit vectors; tokens that all texts have are left out. place counts a text's
    tokens from the rarest on; rest is the length of its vector over the tokens from this one on.
    """
    counts = tokens.groupBy(F.col(id_col).alias("id"), F.col(token_col).alias("token")).agg(F.count("*").alias("c"))
    return _unit_vectors(counts, *_frequencies(counts, tokens.select(F.col(id_col).alias("id"))))


def _frequencies(counts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df) of counts (id, token, c), and the number of texts as one row n."""
    return counts.groupBy("token").agg(F.count("*").alias("df")), ids.distinct().agg(F.count("*").alias("n"))


def _unit_vectors(counts: DataFrame, df: DataFrame, n: DataFrame) -> DataFrame:
    weighted = counts.join(df, "token").crossJoin(F.broadcast(n)).where("df < n").withColumn("w", (1 + F.log("c")) * F.log(F.col("n") / F.col("df")))
    own = Window.partitionBy("id")
    order = own.orderBy("df", "token")
    unit = weighted.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own)))
    rest = F.sqrt(F.greatest(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.lit(0.0)))
    return unit.select("id", "token", "df", "w", F.row_number().over(order).alias("place"), rest.alias("rest"))


def needed_tokens(tokens: DataFrame, best: DataFrame, looked: int) -> DataFrame:
    """Those of `tokens` (weighted) by which a text must still be looked for, as its best so far (id, similarity) was found by its first `looked`.

    Another text that shares none of the tokens before a place is no more like it than `rest` there. Similarities are
    rounded, so a tie may lie a rounding beyond that.
    """
    return tokens.where(F.col("place") > looked).join(best.select("id", "similarity"), "id", "left").where("similarity is null or rest + 1e-9 >= similarity").drop("similarity")


# Levels that the lengths of the rests of vectors are dealt to; texts of a token up to which all meet in the first look; and
# times as many as are common in a group, as what is looked for goes to each group.
LEVELS, FEW, MANY = 8, 32, 16


def _equal_texts(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, first) of texts, first being the smallest id with the same tokens as often, and (first, second) where there are more."""
    token = F.col("token").cast("string")
    entry = F.concat_ws(":", F.length(token).cast("string"), token, F.col("c").cast("string"))
    named = counts.groupBy("id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("key"))
    members = named.join(named.groupBy("key").agg(F.min("id").alias("first")), "key").select("id", "first")
    return members, members.where("id <> first").groupBy("first").agg(F.min("id").alias("second"))


def nearest_by_tokens(tokens: DataFrame, id_col: str = "id", token_col: str = "token", common: int = 1000, looked: int = 2) -> DataFrame:
    """(id, nearest, similarity): the most similar other text by cosine of log tf-idf; ties go to the smaller id.

    Texts with the same tokens as often are looked for once. Each text first meets the `looked` texts in which each of its
    tokens weighs most, and all that share one of its rare tokens. Then a bound decides whom else it meets: two texts
    whose first common token, in order of rarity, is t are no more alike than the product of the lengths of what their
    vectors have from t on. So a text meets, over each of its tokens, only those others with which that product is not
    below its best so far. Lengths are dealt to levels, which are part of the join's key, so that other pairs aren't made;
    vectors travel with the rows that are joined, so that pairs are compared where they are made and none is shuffled.
    Texts of a token and level are dealt to groups of about MANY * `common`.
    """
    spark, folder = tokens.sparkSession, shared_folder(tokens.sparkSession, "nearest")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    counts = kept(tokens.groupBy(F.col(id_col).alias("id"), F.col(token_col).alias("token")).agg(F.count("*").alias("c")), "counts")
    frequencies = _frequencies(counts, tokens.select(F.col(id_col).alias("id")))
    members, seconds = _equal_texts(counts)
    members, seconds = kept(members, "members"), kept(seconds, "seconds")
    unit = _unit_vectors(counts.join(members.where("id = first").select("id"), "id"), *frequencies)
    after = F.sqrt(F.greatest(F.col("rest") * F.col("rest") - F.col("w") * F.col("w"), F.lit(0.0)))
    unit = kept(unit.withColumn("after", after), "unit")
    vectors = unit.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("v"))
    level = F.floor(F.col("rest") * LEVELS).cast("int")
    rows = kept(unit.withColumn("level", level).join(vectors, "id"), "rows")
    shared = F.array_intersect(F.map_keys("v"), F.map_keys("u"))
    alike = F.aggregate(F.array_sort(shared), F.lit(0.0), lambda a, t: a + F.try_element_at("v", t) * F.try_element_at("u", t))

    def best(sims: DataFrame) -> DataFrame:
        got = sims.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("minus"))).alias("b"))
        return got.select("id", (-F.col("b.minus")).alias("nearest"), F.col("b.similarity").alias("similarity"))

    def compared(pairs: DataFrame) -> DataFrame:
        return pairs.where("id <> other").select("id", "other", "least", F.round(alike, 9).alias("similarity")).where("similarity >= least").drop("least")

    # What this first look leaves out only makes the bound of the second one weaker.
    heaviest = Window.partitionBy("token").orderBy(F.desc("w"), "id")
    top = rows.withColumn("at", F.row_number().over(heaviest)).where(F.col("at") <= looked).select("token", "id", "v")
    few = rows.where(F.col("df") <= FEW).select("token", "id", "v")
    others = top.union(few).select("token", F.col("id").alias("other"), F.col("v").alias("u"))
    copies = seconds.select(F.col("first").alias("id"), F.col("second").alias("other"), F.lit(1.0).alias("similarity"))
    first = kept(best(compared(rows.join(others, "token").withColumn("least", F.lit(0.0))).union(copies.join(vectors.select("id"), "id", "left_semi"))), "first")

    sizes = rows.groupBy("token", "level").agg(F.count("*").alias("n")).select("token", "level", F.ceil(F.col("n") / (MANY * common)).cast("int").alias("parts"))
    least = F.coalesce("similarity", F.lit(0.0)) - 2e-9
    asked = rows.join(first.select("id", "similarity"), "id", "left").where(F.col("rest") >= least).withColumn("least", least)
    low = F.greatest(F.floor((F.col("least") / F.col("rest") - 1e-9) * LEVELS), F.lit(0)).cast("int")
    asked = asked.select("id", "token", "w", "rest", "after", "least", "v", F.explode(F.sequence(F.least(low, F.lit(LEVELS)), F.lit(LEVELS))).alias("level"))
    asked = asked.join(sizes, ["token", "level"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = rows.join(sizes, ["token", "level"]).select(F.col("id").alias("other"), "token", "level", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("w").alias("w2"), F.col("after").alias("after2"), F.col("v").alias("u"))
    pairs = asked.drop("rest", "parts").join(dealt, ["token", "level", "part"]).where("w * w2 + after * after2 >= least")
    found = best(first.select("id", F.col("nearest").alias("other"), "similarity").union(compared(pairs)))
    # Copies have a copy as like as can be; what is as like and has a smaller id goes before it.
    own = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    out = members.join(found.withColumnRenamed("id", "first"), "first").join(seconds, "first", "left")
    nearer = (F.col("second").isNotNull()) & ((F.col("similarity") < 1.0) | ((F.col("similarity") == 1.0) & (F.least(own, F.when(F.col("nearest") != F.col("second"), F.col("nearest"))) == own)))
    return out.select("id", F.when(nearer, own).otherwise(F.col("nearest")).alias("nearest"), F.when(nearer, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"))
