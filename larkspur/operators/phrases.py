"""Catalogues of terms as tables: which of very many words and phrases occur in which texts.

A term is found where it stands between word boundaries, regardless of case. Of the terms of one domain the longest at a
place counts, and a found term's letters belong to no other: what one pattern of all terms, the longest first, would find
from left to right. A catalogue may have any number of terms, so they are rows that are joined, not a pattern.

Texts are cut into candidates: beginnings at words whose hash a map of first words marks, and runs of words from there
whose hash a map of terms marks. Both maps have a fixed size, are made by Spark and are broadcast; a full map marks
everything, so a join by equality decides. What is shuffled are candidates, not words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
# Bits of each map: 512 KB, whatever the catalogue.
MAP_BITS = 1 << 22


def catalogue(terms: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """(domain, term, words): lower-cased distinct terms of `terms` and of `overlay` (domain, term), which is private and merged into it.

    A term begins and ends with a word's character and holds no line end; another is an error, as is a null. words: how
    many words it has.
    """
    every = terms.select("domain", "term") if overlay is None else terms.select("domain", "term").unionByName(overlay.select("domain", "term"))
    low = F.lower("term")
    good = low.rlike(r"(?U)\A\w(?:[^\n\r]*\w)?\z")
    wrong = F.raise_error(F.concat(F.lit("no term: "), F.coalesce("term", F.lit("null")))).cast("string")
    return every.select("domain", F.when(good, low).otherwise(wrong).alias("term")).distinct().withColumn("words", F.regexp_count("term", F.lit(r"(?U)\w+")))


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % MAP_BITS


def _map(keys: Column, terms: DataFrame) -> np.ndarray:
    """The bits of the keys' hashes: at most one row for each 64 bits reaches the driver."""
    at = F.crc32(F.encode(keys, "UTF-8")) % MAP_BITS
    words = terms.select((at / 64).cast("int").alias("word"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits"))
    got = words.toPandas()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def candidates(text: str, first: np.ndarray, whole: np.ndarray, most: int) -> list[tuple[str, int, int, int]]:
    """(run of words in lower case, begin, end, line) of a text that may be terms of up to `most` words; lines count from 0."""
    low = text.lower()
    if len(low) != len(text):
        # A letter whose small form is longer; letter by letter places stay comparable.
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = [m.span() for m in WORD.finditer(low)]
    ends = np.array([m.end() for m in re.finditer(r"\r\n|[\n\r\v\f\x1c-\x1e\x85  ]", low)], np.int64)
    out = []
    for i, (a, z) in enumerate(spans):
        if not first[_hash(low[a:z])]:
            continue
        line = int(np.searchsorted(ends, a, side="right"))
        stop = int(ends[line]) if line < len(ends) else len(low)
        for _, z in spans[i : i + most]:
            if z > stop:
                break
            if whole[_hash(low[a:z])]:
                out.append((low[a:z], a, z, line))
    return out


def occurrences(texts: DataFrame, terms: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """key, domain, term, begin, end, line of every term found in `texts`, domain by domain. terms: a catalogue. key: names a row of `texts`.

    Places are code points of the text, ends exclusive.
    """
    spark = texts.sparkSession
    most = terms.agg(F.max("words")).first()[0] or 0
    maps = spark.sparkContext.broadcast((_map(F.regexp_extract("term", r"(?U)\A\w+", 0), terms), _map(F.col("term"), terms)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            found = [candidates(t, *maps.value, most) if t else [] for t in many]
            yield pd.DataFrame({"run": [[c[0] for c in f] for f in found], "begin": [[c[1] for c in f] for f in found], "end": [[c[2] for c in f] for f in found], "line": [[c[3] for c in f] for f in found]})

    cut = F.pandas_udf(run, "run array<string>, begin array<int>, end array<int>, line array<int>")
    maybe = texts.select(*key, cut(F.col(text_col)).alias("c")).select(*key, F.inline(F.arrays_zip("c.run", "c.begin", "c.end", "c.line")))
    met = maybe.join(terms.select("domain", F.col("term").alias("run")), "run")
    # From left to right, the longest first; what begins within a term that was taken is passed over.
    order = F.struct(F.col("begin").alias("b"), (-F.col("end")).alias("e"), F.col("run").alias("term"), F.col("line").alias("line"))
    lists = met.groupBy(*key, "domain").agg(F.array_sort(F.collect_list(order)).alias("all"))
    none = F.slice("all", 1, 0)
    taken = F.aggregate("all", F.struct(F.lit(0).alias("at"), none.alias("kept")), lambda s, x: F.when(x["b"] >= s["at"], F.struct((-x["e"]).alias("at"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))
    return lists.select(*key, "domain", F.explode(taken["kept"]).alias("x")).select(*key, "domain", F.col("x.term").alias("term"), F.col("x.b").alias("begin"), (-F.col("x.e")).alias("end"), F.col("x.line").alias("line"))


def hits(found: DataFrame, key: list[str]) -> DataFrame:
    """key, domain, term, times, lines of `occurrences`: how often, and on how many lines, each term is found."""
    return found.groupBy(*key, "domain", "term").agg(F.count("*").alias("times"), F.countDistinct("line").alias("lines"))


def retained(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, domain, terms, kept, retention: of the distinct terms of a source, how many its output still has. Both from `occurrences`."""
    own, left = (x.select(*key, "domain", "term").distinct() for x in (before, after))
    both = own.join(left.withColumn("_kept", F.lit(1)), [*key, "domain", "term"], "left")
    return both.groupBy(*key, "domain").agg(F.count("*").alias("terms"), F.count("_kept").alias("kept")).withColumn("retention", F.col("kept") / F.col("terms"))
