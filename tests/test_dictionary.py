"""The cipher of words, keys, and the dictionary of a corpus."""

from __future__ import annotations

import itertools
import random

import pytest

from larkspur.functions.cipher import ALPHABET, WIDE, WordCipher
from larkspur.operators import dictionary
from larkspur.operators.updates import refuse_maps

KEY = bytes(range(16))


def test_the_cipher_is_a_bijection_of_short_words():
    c = WordCipher(KEY, frozenset(("if", "go", "Xy")))
    every = ["".join(w) for w in itertools.product(ALPHABET, repeat=2)]
    assert sorted(map(c.once, every)) == sorted(every) and all(c.back(c.once(w)) == w for w in every[::7])
    usable = [w for w in every if c.usable(w)]
    out = [c.encrypt(w) for w in usable]
    assert sorted(out) == sorted(usable) and [c.decrypt(w) for w in out] == usable
    assert len(usable) == 53 * 63 - 3 and not {"if", "go", "Xy"} & set(out)


@pytest.mark.parametrize("n", [1, 3, 4, 7, 12, 33, 200])
def test_the_cipher_keeps_length_and_is_undone(n):
    rng, c, other = random.Random(n), WordCipher(KEY), WordCipher(bytes(16))
    words = list({rng.choice(ALPHABET[:52]) + "".join(rng.choice(ALPHABET) for _ in range(n - 1)) for _ in range(200)})
    out = [c.encrypt(w) for w in words]
    assert all(len(o) == n and c.takes(o) and not o[0].isdigit() for o in out) and len(set(out)) == len(words)
    assert [c.decrypt(o) for o in out] == words and [WordCipher(KEY).encrypt(w) for w in words] == out
    assert n == 1 or out != [other.encrypt(w) for w in words]
    for bad in ("", "9a"):
        with pytest.raises(ValueError, match="usable"):
            c.encrypt(bad)


def test_words_of_other_letters_become_such_words():
    rng, c = random.Random(2), WordCipher(KEY, frozenset(("für",)), WIDE)
    words = list({"".join(rng.choice("éñüßаbcλ_x9") for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    words = [w for w in words if not w.isascii() and not w[0].isdigit()]
    out = [c.encrypt(w) for w in words]
    assert all(len(o) == len(w) and not o.isascii() and o.isidentifier() for o, w in zip(out, words, strict=True)) and len(set(out)) == len(words)
    assert [c.decrypt(o) for o in out] == words and not c.takes("漢字")


def test_keys():
    assert dictionary.load_key({"LARKSPUR_KEY": "ab" * 20}) == (bytes.fromhex("ab" * 16), "given")
    assert dictionary.load_key({"LARKSPUR_DEMO_KEY": "1"})[1] == "demo" and dictionary.load_key({})[1] == "random" and dictionary.load_key({}) != dictionary.load_key({})
    for env, why in (({"LARKSPUR_KEY": "xyz"}, "no hex"), ({"LARKSPUR_KEY": "0011", "LARKSPUR_DEMO_KEY": "1"}, "2 bytes"), ({"LARKSPUR_ENV": "production"}, "needed in production")):
        with pytest.raises(ValueError, match=why):
            dictionary.load_key(env)
    assert dictionary.load_key({"LARKSPUR_ENV": "production", "LARKSPUR_ALLOW_RANDOM_KEY": "1"})[1] == "random"


def corpus(spark, rng, n=60):
    words = [f"{rng.choice(['load', 'Save', '_x', 'naïve', '漢字', 'print', 'for', 'config'])}{rng.choice(['', 'Turbine', '_rotor', '9', 'Über'])}" for _ in range(40)]
    rows = [(i, "\n".join(f'{rng.choice(words)} = {rng.choice(words)}("{rng.choice(words)}") // {rng.choice(words)}' for _ in range(rng.randrange(12)))) for i in range(n)] + [(900, None), (901, ""), (902, 'for = print("s") // naïve')]
    return spark.createDataFrame(rows, "i int, text string").repartition(3)


@pytest.mark.parametrize("level", [0, 1, 2])
def test_round_trip_over_a_corpus(spark, level, monkeypatch):
    monkeypatch.setattr(dictionary, "HOT_ROWS", 20)
    texts = corpus(spark, random.Random(level))
    words = dictionary.words_of(texts, ["i"])
    entries = dictionary.dictionary(words, KEY, level).cache()
    got = {r["word"]: r for r in entries.collect()}
    assert len({r["pseudonym"] for r in got.values()}) == len(got) and all(len(r["pseudonym"]) == len(w) for w, r in got.items())
    assert {r["kind"] for r in got.values()} == {"plain", "cipher", "wide", "hashed"} and got["for"]["pseudonym"] == "for" and (got["print"]["kind"] == "plain") == (level >= 1)
    assert all(r["kind"] == ("cipher" if w.isascii() else "hashed" if "漢" in w else "wide") for w, r in got.items() if r["kind"] != "plain")
    out = dictionary.pseudonymised(texts, words, entries, ["i"]).cache()
    named = {r["i"]: (r["text"], r["output"]) for r in out.collect()}
    assert named[900] == (None, None) and named[901] == ("", "")
    for text, output in named.values():
        if text:
            # Strings and comments stay; every other word is its entry's.
            assert [x.split('"')[1] for x in text.split("\n")] == [x.split('"')[1] for x in output.split("\n")]
            assert [got[w]["pseudonym"] for w in dictionary._words(text)] == dictionary._words(output)
    back = dictionary.way_back(entries)
    with pytest.raises(ValueError, match="re-identification"):
        refuse_maps(back)
    again = dictionary.restored(out.select("i", "output"), back, ["i"])
    assert {r["i"]: r["output"] for r in again.collect()} == {i: t for i, (t, _) in named.items()}


def test_an_ambiguous_map_is_refused_across_files(spark):
    make = lambda *rows: spark.createDataFrame([(*r, 1, 1) for r in rows], "word string, pseudonym string, kind string, times long, rows long")
    good = make(("alpha", "qwert", "cipher"), ("if", "if", "plain"))
    assert dictionary.way_back(good).count() == 1 and dictionary.ambiguous(good).count() == 0
    # Each word is in another file, so no file by itself sees the clash.
    with pytest.raises(ValueError, match="qwert for alpha, bravo: several words"):
        dictionary.way_back(good.union(make(("bravo", "qwert", "hashed"))))
    with pytest.raises(ValueError, match="qwert for alpha: stands in plain text"):
        dictionary.way_back(good.union(make(("qwert", "qwert", "plain"))))
    assert {r["reason"] for r in dictionary.ambiguous(good.union(make(("bravo", "qwert", "hashed"), ("qwert", "qwert", "plain")))).select("reason").distinct().collect()} == {"several words", "stands in plain text"}
    assert dictionary.words_of(spark.createDataFrame([], "i int, text string"), ["i"]).count() == 0


def test_output_is_made_once(spark, sf):
    """What three steps read is a written table, not computed for each."""
    from larkspur.plans import registry as plans

    plan = plans.queries()["t07_dictionary"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
