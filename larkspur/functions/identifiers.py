"""Keyed pseudonyms of identifiers and their reversal.

Small per-row helpers run in pandas UDFs; the key is fixed on the driver and travels with the function, so each worker
and each attempt gives the same pseudonyms.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import in_parts

# Words that stay at every level; built-in names from level 1; general nouns from level 2.
KEYWORDS = frozenset("break case catch class const continue def default defer del do elif else enum except export extends false finally for from func function go if implements import in interface is lambda let new nil None not null or package pass private protected public raise return self static struct super switch this throw true try type var void while with yield".split())
BUILTINS = frozenset("append bool dict error float int len list map max min print range set str string sum tuple".split())
GENERIC = frozenset("config count data handler id index item key name result state value".split())

# Quoted strings and comments are passed over; numbers too; identifiers have two characters or more.
TOKEN = re.compile(r"""(?P<skip>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|#[^\n]*|\d\w*)|(?P<word>[^\W\d]\w+)""")
# Quotes of a line up to which an unclosed one may be looked at again for each.
FEW_QUOTES = 64
WORD_KEY = re.compile(r"[A-Za-z0-9_]+")
# Pseudonyms that a task holds at most, but for those of one text.
MOST_HELD = 100_000


def load_key(environ: dict[str, str] | None = None, name: str = "LARKSPUR_KEY") -> bytes:
    """16 bytes from a hex variable, or drawn at random; call it on the driver, once."""
    value = (os.environ if environ is None else environ).get(name)
    if value is None:
        return os.urandom(16)
    key = bytes.fromhex(value)
    if len(key) < 16:
        raise ValueError("a key has 16 bytes or more")
    return key[:16]


def spared(level: int, word: str) -> bool:
    """Whether a word stays as it is: more words do at higher levels."""
    if word in KEYWORDS or (level >= 1 and word in BUILTINS) or (level >= 2 and word.lower() in GENERIC):
        return True
    return level >= 3 and len(re.findall("[A-Z]", word[1:])) < 3 and word.count("_") < 3 and len(word) < 12


def pseudonym(key: bytes, word: str) -> str:
    """As long as the word, its first character of the same kind; hashed again until it is no spared word."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    for again in range(100):
        digest = b"".join(hashlib.blake2b(f"{again}:{i}:{word}".encode(), key=key).digest() for i in range(len(word) // 64 + 1))
        rest = "".join((letters + "0123456789")[b % 36] for b in digest[1 : len(word)])
        first = "_" if word[0] == "_" else letters[digest[0] % 26].upper() if word[0].isupper() else letters[digest[0] % 26]
        out = (first + rest).ljust(len(word), "x")
        if not spared(2, out) and out != word:
            return out
    raise ValueError("no pseudonym found")


@functools.cache
def _tokens(quotes: str) -> re.Pattern:
    """TOKEN with only some kinds of quotes, and a quote of these kinds that the line doesn't close."""
    closed = "".join(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}|" for q in quotes)
    dead = rf"(?P<dead>[{quotes}])|" if quotes else ""
    return re.compile(rf"(?P<skip>{closed}//[^\n]*|#[^\n]*|\d\w*)|{dead}(?P<word>[^\W\d]\w+)")


def replaced(replace: Callable[[re.Match], str], text: str) -> str:
    """TOKEN.sub in linear time: where a line has many quotes, a kind that is once unclosed is left out of its rest."""
    many = lambda x: x.count('"') + x.count("'") > FEW_QUOTES
    if not many(text):
        return TOKEN.sub(replace, text)

    def line_of(line: str) -> str:
        out, at, quotes = [], 0, "\"'"
        while at is not None:
            rest, after = at, None
            for m in _tokens(quotes).finditer(line, at):
                if m.lastgroup == "dead":
                    quotes, after = quotes.replace(m[0], ""), m.end()
                    break
                out += [line[rest : m.start()], replace(m)]
                rest = m.end()
            out.append(line[rest:after])
            at = after
        return "".join(out)

    return "\n".join(line_of(x) if many(x) else TOKEN.sub(replace, x) for x in text.split("\n"))


def pseudonymise_one(text: str | None, key: bytes, level: int, cache: dict[str, str]) -> tuple:
    """(output, replaced, skipped, distinct, collisions, map back) of one text; cache: pseudonyms met before."""
    counts, back, used = [0, 0], {}, {}

    def replace(m: re.Match) -> str:
        w = m["word"]
        if w is None:
            return m[0]
        if spared(level, w):
            counts[1] += 1
            return w
        counts[0] += 1
        p = cache.get(w) or cache.setdefault(w, pseudonym(key, w))
        used[w] = p
        back.setdefault(p, w)
        return p

    out = None if text is None else replaced(replace, text)
    if len(cache) > MOST_HELD:
        cache.clear()
    return out, counts[0], counts[1], len(used), len(used) - len(back), back


def reverse_one(text: str | None, mapping: dict | None) -> tuple[str | None, int]:
    """(text with pseudonyms put back, substitutions): longest first, words only at word boundaries."""
    keys = sorted((k for k in (mapping or {}) if k), key=len, reverse=True)
    if text is None or not keys:
        return text, 0
    others = [k for k in keys if not WORD_KEY.fullmatch(k)]
    if not any(WORD_KEY.match(k) for k in others):
        # Word keys match whole runs of word characters only, so each run is looked up.
        n = 0

        def known(x: re.Match) -> str:
            nonlocal n
            to = mapping.get(x[0])
            n += to is not None
            return x[0] if to is None else to

        return re.compile("|".join([*map(re.escape, others), WORD_KEY.pattern])).sub(known, text), n
    parts = [rf"(?<![A-Za-z0-9_]){re.escape(k)}(?![A-Za-z0-9_])" if WORD_KEY.fullmatch(k) else re.escape(k) for k in keys]
    return re.compile("|".join(parts)).subn(lambda x: mapping[x[0]], text)


def pseudonymise(text: Column, key: bytes, level: int = 1) -> Column:
    """struct(output, replaced, skipped, distinct, collisions, reidentify_map) of a text.

    Equal words have equal pseudonyms of equal length. The map is for the caller and isn't to be written with results.
    A null text gives a null output.
    """

    columns = ["output", "replaced", "skipped", "distinct", "collisions", "reidentify_map"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        yield from in_parts(lambda texts: pd.DataFrame([pseudonymise_one(t, key, level, cache) for t in texts], columns=columns))(batches)

    return F.pandas_udf(run, "output string, replaced long, skipped long, distinct long, collisions long, reidentify_map map<string,string>")(text)


def checked(text: Column, key: bytes, level: int = 1) -> Column:
    """struct(output, replaced, distinct, collisions, round_trip): the way back is tried where the map is, which stays there."""

    columns = ["output", "replaced", "distinct", "collisions", "round_trip"]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}

        def one(t: str | None) -> tuple:
            output, n, _, distinct, collisions, back = pseudonymise_one(t, key, level, cache)
            return output, n, distinct, collisions, reverse_one(output, back)[0] == t

        yield from in_parts(lambda texts: pd.DataFrame([one(t) for t in texts], columns=columns))(batches)

    return F.pandas_udf(run, "output string, replaced long, distinct long, collisions long, round_trip boolean")(text)


def reverse(text: Column, mapping: Column) -> Column:
    """struct(output, substitutions): pseudonyms back to originals, longest first, words only at word boundaries."""

    columns = ["output", "substitutions"]
    part = in_parts(lambda texts, maps: pd.DataFrame([reverse_one(t, dict(m) if m is not None else None) for t, m in zip(texts, maps, strict=True)], columns=columns))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from part(batches)

    return F.pandas_udf(run, "output string, substitutions long")(text, mapping)
