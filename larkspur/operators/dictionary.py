"""A dictionary of a corpus's identifiers: each distinct word is enciphered once, and joined back to the texts it is in.

As words of all texts meet in one table, what a text by itself can't see is seen here: two words with one pseudonym in
different files, and a pseudonym that stands elsewhere as a word in plain text. With either the way back is ambiguous,
and a map is refused. The map is a table of its own; results hold none.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import identifiers
from larkspur.functions.batches import in_parts
from larkspur.functions.cipher import WIDE, WordCipher

# Words of more rows than this, and than one in MOST_HOT of all, are joined by broadcast; there are MOST_HOT of them at most.
HOT_ROWS, MOST_HOT = 10_000, 100_000


def load_key(environ: Mapping[str, str] | None = None, prefix: str = "LARKSPUR") -> tuple[bytes, str]:
    """(key, where it is from) by the environment; call it on the driver, once.

    `<prefix>_KEY` has 16 bytes or more in hex; anything else there is an error, never passed over. `<prefix>_DEMO_KEY`,
    if set, gives a key that everyone knows. Without either a random one is drawn, but not where `<prefix>_ENV` is
    `production`, unless `<prefix>_ALLOW_RANDOM_KEY` is set.
    """
    env = os.environ if environ is None else environ
    given = env.get(f"{prefix}_KEY")
    if given:
        try:
            key = bytes.fromhex(given)
        except ValueError:
            raise ValueError(f"{prefix}_KEY is no hex") from None
        if len(key) < 16:
            raise ValueError(f"{prefix}_KEY has {len(key)} bytes; 16 are needed")
        return key[:16], "given"
    if env.get(f"{prefix}_DEMO_KEY"):
        return bytes(range(16)), "demo"
    if env.get(f"{prefix}_ENV") == "production" and not env.get(f"{prefix}_ALLOW_RANDOM_KEY"):
        raise ValueError(f"{prefix}_KEY is needed in production")
    return os.urandom(16), "random"


def reserved(level: int) -> frozenset[str]:
    """Words that stay at a level whatever their form, and so can be no pseudonyms."""
    return identifiers.KEYWORDS | (identifiers.BUILTINS if level >= 1 else frozenset()) | (identifiers.GENERIC if level >= 2 else frozenset())


def _words(text: str) -> list[str]:
    """Identifiers of a text in order, those within strings and comments left out."""
    out: list[str] = []

    def note(m: re.Match) -> str:
        if m["word"] is not None:
            out.append(m["word"])
        return m[0]

    identifiers.replaced(note, text)
    return out


def words_of(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """key, word, times: the distinct identifiers of each row of `texts`. key: names a row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def tallies(many: pd.Series) -> pd.DataFrame:
            rows = []
            for t in many:
                tally: dict[str, int] = {}
                for w in _words(t or ""):
                    tally[w] = tally.get(w, 0) + 1
                rows.append((list(tally), list(tally.values())))
            return pd.DataFrame(rows, columns=["word", "times"])

        yield from in_parts(tallies)(batches)

    found = F.pandas_udf(run, "word array<string>, times array<long>")(F.col(text_col))
    return texts.select(*key, found.alias("f")).select(*key, F.inline(F.arrays_zip("f.word", "f.times")))


def dictionary(words: DataFrame, key: bytes, level: int = 1) -> DataFrame:
    """word, pseudonym, kind, times, rows of all distinct words of `words` (word, times).

    kind: `plain` stays as it is, at this level; `cipher` is enciphered by the bijection of ASCII words, `wide` by that of
    words with other European letters; `hashed` has letters beyond and gets a keyed hash of the same length, which may clash.
    """
    distinct = words.groupBy("word").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    kept = reserved(level)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cipher, wide = WordCipher(key, kept), WordCipher(key, kept, WIDE)

        def one(w: str) -> tuple[str, str]:
            if identifiers.spared(level, w):
                return w, "plain"
            if cipher.takes(w):
                return cipher.encrypt(w), "cipher"
            return (wide.encrypt(w), "wide") if wide.takes(w) else (identifiers.pseudonym(key, w), "hashed")

        for many in batches:
            yield pd.DataFrame([one(w) for w in many], columns=["pseudonym", "kind"])

    made = F.pandas_udf(run, "pseudonym string, kind string")("word")
    return distinct.select("word", made.alias("p"), "times", "rows").select("word", "p.pseudonym", "p.kind", "times", "rows")


def ambiguous(entries: DataFrame) -> DataFrame:
    """pseudonym, words, reason: pseudonyms of several words, and those that stand elsewhere as a word in plain text."""
    made = entries.where("kind <> 'plain'")
    several = made.groupBy("pseudonym").agg(F.sort_array(F.collect_list("word")).alias("words")).where(F.size("words") > 1).withColumn("reason", F.lit("several words"))
    plain = made.join(entries.where("kind = 'plain'").select(F.col("word").alias("pseudonym")), "pseudonym").select("pseudonym", F.array("word").alias("words"), F.lit("stands in plain text").alias("reason"))
    return several.unionByName(plain)


def way_back(entries: DataFrame) -> DataFrame:
    """(pseudonym, reidentify_map): the map back as a table; an ambiguous dictionary is refused. Its column's name keeps it out of results."""
    bad = ambiguous(entries).first()
    if bad:
        raise ValueError(f"the map is ambiguous: {bad['pseudonym']} for {', '.join(bad['words'])}: {bad['reason']}")
    return entries.where("kind <> 'plain'").select("pseudonym", F.col("word").alias("reidentify_map"))


def _joined(words: DataFrame, entries: DataFrame) -> DataFrame:
    """`words` with their entries; words of very many rows are not shuffled."""
    bound = max(HOT_ROWS, (entries.agg(F.sum("rows")).first()[0] or 0) // MOST_HOT)
    hot = entries.where(F.col("rows") > bound)
    rest = words.join(F.broadcast(hot.select("word")), "word", "left_anti").join(entries.where(F.col("rows") <= bound), "word")
    return words.join(F.broadcast(hot), "word").unionByName(rest)


def _substituted(texts: DataFrame, pairs: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """`texts` and output: identifiers replaced by their row's pairs (key, was, becomes)."""
    lists = pairs.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("was", "becomes"))).alias("_pairs"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for many, maps in batches:
            out = []
            for t, m in zip(many, maps, strict=True):
                to = dict(m) if m is not None else {}
                out.append(None if t is None else identifiers.replaced(lambda x, to=to: x[0] if x["word"] is None else to.get(x["word"], x["word"]), t) if to else t)
            yield pd.Series(out, dtype=object)

    both = texts.join(lists, key, "left")
    return both.withColumn("output", F.pandas_udf(run, "string")(F.col(text_col), F.col("_pairs"))).drop("_pairs")


def pseudonymised(texts: DataFrame, words: DataFrame, entries: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """`texts` and output, of `words_of` the texts and their dictionary."""
    named = _joined(words.select(*key, "word"), entries.where("kind <> 'plain'"))
    return _substituted(texts, named.select(*key, F.col("word").alias("was"), F.col("pseudonym").alias("becomes")), key, text_col)


def restored(texts: DataFrame, back: DataFrame, key: list[str], text_col: str = "output", words: DataFrame | None = None) -> DataFrame:
    """`texts` and output: pseudonyms put back by a map of `way_back`. words: `words_of` the texts, if they are there."""
    words = words_of(texts, key, text_col) if words is None else words
    entries = words.groupBy("word").agg(F.count("*").alias("rows")).join(back.select(F.col("pseudonym").alias("word"), F.col("reidentify_map").alias("becomes")), "word")
    named = _joined(words.select(*key, "word"), entries).select(*key, F.col("word").alias("was"), "becomes")
    return _substituted(texts.withColumnRenamed(text_col, "_text"), named, key, "_text").drop("_text")
