"""Catalogues of terms as tables, against one pattern of all terms."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.operators import phrases


def pattern(terms):
    return re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(terms, key=lambda t: (-len(t), t))))})\b", re.I)


def plain(texts, terms):
    """(id, domain, term, begin, end, line) as each domain's pattern finds them, line by line."""
    out = set()
    for domain in {d for d, _ in terms}:
        p = pattern({t.lower() for d, t in terms if d == domain})
        for i, text in texts:
            at = 0
            for n, line in enumerate((text or "").splitlines(keepends=True)):
                out |= {(i, domain, m[0].lower(), at + m.start(), at + m.end(), n) for m in p.finditer(line)}
                at += len(line)
    return out


@pytest.fixture(scope="module")
def found(spark):
    def run(texts, terms, overlay=None):
        make = lambda t: spark.createDataFrame(t, "domain string, term string")
        c = phrases.catalogue(make(terms), make(overlay) if overlay else None)
        df = spark.createDataFrame(texts, "i int, text string").repartition(3)
        return phrases.occurrences(df, c, ["i"])

    return run


def rows(df):
    got = [(r["i"], r["domain"], r["term"], r["begin"], r["end"], r["line"]) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_phrases_equal_the_pattern(found):
    rng = random.Random(4)
    words = ["air", "traffic", "control", "body_sha256", "real-time", "x", "Tower", "über", "naïve", "log", "a", "9"]
    parts = [*words, *words, "\n", ", ", "-", " ", "  ", "\r\n", ".", "'s", "😀"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60)))) for i in range(300)] + [(900, None), (901, "")]
    terms = [("sky", t) for t in ("Air", "air traffic", "air traffic control", "traffic control", "tower", "control tower")] + [("web", t) for t in ("real-time", "real", "time log", "body_sha256", "ÜBER", "naïve x", "x", "x's", "9", "a 9", "air")]
    assert rows(found(texts, terms)) == plain(texts, terms)


def test_an_overlay_is_merged(found):
    texts = [(1, "the secret plan and the open plan")]
    assert rows(found(texts, [("d", "open plan")], [("d", "Secret Plan"), ("e", "plan"), ("d", "open plan")])) == {(1, "d", "open plan", 24, 33, 0), (1, "d", "secret plan", 4, 15, 0), (1, "e", "plan", 11, 15, 0), (1, "e", "plan", 29, 33, 0)}


def test_a_hundred_thousand_terms(spark, found):
    rng = random.Random(6)
    word = lambda: "w" + str(rng.randrange(3000))
    terms = list({(f"d{k % 3}", " ".join(word() for _ in range(1 + k % 3)) if k % 3 else f"w{k % 500}x") for k in range(100_000)})
    assert len(terms) > 60_000
    texts = [(i, " ".join(word() for _ in range(200))) for i in range(60)]
    known, want = {}, Counter()
    for d, t in terms:
        known.setdefault(d, set()).add(t)
    for i, text in texts:
        w = text.split()
        for d, own in known.items():
            at = 0
            while at < len(w):
                n = next((n for n in (3, 2, 1) if at + n <= len(w) and " ".join(w[at : at + n]) in own), 0)
                if n:
                    want[i, d, " ".join(w[at : at + n])] += 1
                at += n or 1
    got = phrases.hits(found(texts, terms), ["i"])
    assert {(r["i"], r["domain"], r["term"]): r["times"] for r in got.collect()} == want and len(want) > 30


def test_retention_and_wrong_terms(spark, found):
    before, after = found([(1, "alpha beta. gamma\nalpha beta")], [("d", "alpha beta"), ("d", "gamma")]), found([(1, "Alpha  beta, ALPHA beta")], [("d", "alpha beta"), ("d", "gamma")])
    r = phrases.retained(before, after, ["i"]).first()
    assert (r["terms"], r["kept"], r["retention"]) == (2, 1, 0.5)
    assert [(r["times"], r["lines"]) for r in phrases.hits(before, ["i"]).orderBy("term").collect()] == [(2, 2), (1, 1)]
    for bad in ("c++", "", " a", "a\nb", None):
        with pytest.raises(Exception, match="no term"):
            phrases.catalogue(spark.createDataFrame([("d", bad)], "domain string, term string")).collect()
    none = spark.createDataFrame([], "domain string, term string")
    assert phrases.occurrences(spark.createDataFrame([(1, "a b")], "i int, text string"), phrases.catalogue(none), ["i"]).count() == 0
