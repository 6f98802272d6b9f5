"""Named text transforms, each a function of a DataFrame with a `text` column."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transform:
    slug: str
    description: str
    apply: Callable[..., DataFrame]


_TRANSFORMS: dict[str, Transform] = {}


def register_transform(slug: str, description: str):
    """Register under a slug; a second one is an error."""

    def add(f: Callable[..., DataFrame]):
        if slug in _TRANSFORMS:
            raise ValueError(f"{slug} is registered already")
        _TRANSFORMS[slug] = Transform(slug, description, f)
        return f

    return add


def transform(df: DataFrame, slug: str, **options) -> DataFrame:
    if slug not in _TRANSFORMS:
        raise KeyError(f"unknown transform: {slug}")
    return _TRANSFORMS[slug].apply(df, **options)


def batch(df: DataFrame, slug: str, family: str, **options) -> DataFrame:
    """`df` (with text) through one transform: output_sha256, and the nine counters before, after and their difference.

    A row whose output is null has no counters after it; `error` says so.
    """
    from .code import COUNTER_NAMES, counters

    out = transform(df, slug, **options)
    before, after = (F.struct(*counters(F.col(c), family)) for c in ("text", "output"))
    out = out.withColumn("before", before).withColumn("after", F.when(F.col("output").isNotNull(), after))
    delta = F.struct(*[(F.col(f"after.{c}") - F.col(f"before.{c}")).alias(c) for c in COUNTER_NAMES])
    error = F.when(F.col("output").isNull(), "no output")
    return out.withColumn("delta", F.when(F.col("after").isNotNull(), delta)).withColumn("output_sha256", F.sha2("output", 256)).withColumn("error", error)


def list_transforms(spark: SparkSession) -> DataFrame:
    """(slug, description), sorted."""
    return spark.createDataFrame([(t.slug, t.description) for _, t in sorted(_TRANSFORMS.items())], "slug string, description string")


@register_transform("reverse-text", "The text backwards")
def reverse_text(df: DataFrame) -> DataFrame:
    return df.withColumn("output", F.reverse("text"))


@register_transform("pseudonymise", "Identifiers replaced by keyed pseudonyms")
def pseudonymise(df: DataFrame, key: bytes, level: int = 1) -> DataFrame:
    from .identifiers import pseudonymise as run

    return df.withColumn("_r", run(F.col("text"), key, level)).select(*df.columns, "_r.output", "_r.replaced", "_r.distinct", "_r.collisions")


@register_transform("tag-literals", "String literals replaced by tags of their class")
def tag_literals(df: DataFrame, doc: str, level: int = 1) -> DataFrame:
    from .literals import tag_texts

    return tag_texts(df, doc, "text", level)


@register_transform("composed", "Literals tagged, then identifiers replaced")
def composed(df: DataFrame, doc: str, key: bytes, level: int = 1) -> DataFrame:
    """`df`, output and chain: both transforms in turn; neither's map is kept."""
    from .identifiers import pseudonymise as run

    out = tag_literals(df, doc, level).withColumn("output", run(F.col("output"), key, level)["output"])
    return out.drop("literals_by_class", "total_literals").withColumn("chain", F.array(F.lit("tag-literals"), F.lit("pseudonymise")))


def arms(df: DataFrame, names: Sequence[str], doc: str, family: str, key: bytes, level: int = 1) -> DataFrame:
    """(doc, arm, output): each text as every arm of an experiment shows it. An arm is `source` (as it is), `blind` (its
    profile) or a registered transform; an unknown one is an error."""
    from .code import profile

    def output(name: str) -> DataFrame:
        if name == "source":
            return df.withColumn("output", F.col("text"))
        if name == "blind":
            return df.withColumn("output", profile(F.col("text"), family))
        options = {"pseudonymise": {"key": key, "level": level}, "tag-literals": {"doc": doc, "level": level}, "composed": {"doc": doc, "key": key, "level": level}}
        return transform(df, name, **options.get(name, {}))

    shown = [output(n).select(doc, F.lit(n).alias("arm"), "output") for n in names]
    return functools.reduce(DataFrame.unionByName, shown)


def transform_tree(spark: SparkSession, path: str, slug: str, family: str, target: str, **options) -> DataFrame:
    """A source tree through one transform with one target for all files: (path, target, output, output_sha256, delta, error)."""
    from larkspur.sources.records import source_tree

    files = source_tree(spark, path).select("path", F.col("content").alias("text"))
    return batch(files, slug, family, **options).withColumn("target", F.lit(target)).select("path", "target", "output", "output_sha256", "delta", "error")
