"""Toxicity, hard negatives and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import hard_negatives, queries, toxicity, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def table(sf):
    texts = [t for (t,) in duckdb.sql(f"select text from '{sf}/../sf0.01/documents.parquet'").fetchall()]
    return toxicity.gram_counts(texts).astype(np.float32)


# Toxicity.


def test_grams_are_counted_over_all_rows(spark):
    texts = ["Ab  ab\nc", None, "", "xyz!", "Ab  ab\nc"] * 7
    got = toxicity.count_grams(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    want = Counter()
    # Texts are counted task by task, with one space between two of them, so only runs within a text are compared.
    for t in texts:
        s = " " + " ".join((t or "").lower().split()) + " "
        want.update(s[i : i + n] for n in range(1, 6) for i in range(len(s) - n + 1) if s[i : i + n].strip() and " " not in s[i : i + n].strip())
    for gram, n in want.items():
        if gram.strip() == gram:
            assert got[toxicity._bucket(gram)] == n, gram


@pytest.mark.parametrize("token", ["1d10t", "!!d1ot", "sttuuupid", "l0s3r$", "aaa", "x", "p@th33t1c"])
def test_decoding_finds_the_likeliest_of_all_paths(table, token):
    model, options = toxicity.CharModel(table, 4.0), toxicity.ChannelOptions()
    steps = toxicity.lattice(token, False, options)

    def value(path):
        total, context = sum(p for _, p in path), " "
        for c in "".join(t for t, _ in path) + " ":
            total += model.log_p(context, c)
            context = (context + c)[1 - toxicity.ORDER :]
        return total

    best = max(value(path) for path in itertools.product(*steps))
    got = toxicity.decode(steps, model)
    assert math.isclose(max(value(path) for path in itertools.product(*steps) if "".join(t for t, _ in path) == got), best, rel_tol=1e-12)


def test_disguised_words_are_restored(table):
    r = toxicity.Restorer(table)
    pairs = {"1d10t": "idiot", "I D I O T": "idiot", "i.d.i.o.t": "idiot", "p@th3t1c!!": "pathetic!!", "stuuuuupid": "stupid", "W0RTHL3SS": "worthless", "$cum,": "scum,", "w o r t h l e s s": "worthless"}
    for disguised, plain in pairs.items():
        assert r.text(f"of the {disguised} and") == f"of the {plain} and"
    for plain in ["", "of the and", "in 2019 or 3.14", "Of\tthe\n and  it", "https://a.b/c?d=1&e=2", "###", "xy" * 2500 + "9", "😀 1 ｆ"]:
        assert r.text(plain).lower() == plain.lower() or "http" in plain
    assert r.text(None) == ""
    assert [toxicity.margins(t) for t in ("", "!!", "$cum,", "idiot$$$", "$$$%a1$", "(1d)", "@@", "a")] == [(0, 0), (0, 0), (0, 4), (0, 5), (4, 7), (1, 3), (0, 0), (0, 1)]
    assert r.text("1d10t$$$ %%%id1ot***") == "idiot$$$ %%%idiot***"


def test_weights_are_optimal():
    rng = np.random.default_rng(2)
    x = rng.random((400, 60)) < 0.15
    y = (rng.random(400) < np.where(x[:, 3] | x[:, 7], 0.9, 0.1)).astype(int)
    row, at = np.nonzero(x)
    options = toxicity.FitOptions(ease=1.0, steps=3000)
    w, bias = toxicity.fit_weights(row, at, y, options)
    assert set(np.flatnonzero(w)) == {3, 7} and (w[[3, 7]] > 1).all()
    off = 1 / (1 + np.exp(-(x @ w[:60] + bias))) - y
    penalty = options.deviations * (np.sqrt(x.sum(axis=0) * y.mean() * (1 - y.mean())) + 1) / 400
    slope = x.T.astype(float) @ off / 400
    assert abs(off.mean()) < 1e-4 and (np.abs(slope) < penalty + 1e-4).all() and np.allclose(slope[[3, 7]], -penalty[[3, 7]], atol=1e-4)


def test_features_are_words_and_beginnings():
    owner, at = toxicity.features(["Disgusting, the", "", "disgusting"])
    assert (owner == 1).sum() == 0 and set(at[owner == 2].tolist()) < set(at[owner == 0].tolist())
    assert len(at[owner == 2]) == 1 + len(toxicity.BEGINNINGS)


def made_documents(n, rng):
    """Half with one word of a list, of these a third disguised."""
    plain = ["the", "and", "bridge", "water", "garden", "old", "people", "market", "street", "morning", "river", "table"]
    bad, leet = ["wretched", "filthy", "horrid"], str.maketrans("eioa", "310@")
    rows = []
    for i in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(20, 60))]
        toxic = i % 2
        if toxic:
            w = rng.choice(bad)
            words[rng.randrange(len(words))] = (w, w.translate(leet), " ".join(w), w[:2] + w[2] * 4 + w[3:])[0 if i % 3 else 1 + i // 6 % 3]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_disguised_toxic_documents_are_caught(spark):
    rows = made_documents(900, random.Random(4))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 500], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    new = [r for r in rows if r[0] >= 500]
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in new)


def test_held_out_toxicity(spark, sf):
    folder = f"{sf}/../sf0.01"
    got = queries.op11_toxicity(spark, folder).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet' where toxic is not null").fetchall())
    new = [(p, truth[i]) for i, p, h in zip(got["doc_id"], got["predicted"], got["held_out"], strict=True) if h and i in truth]
    caught = sum(p and t for p, t in new)
    # About 300 labels to learn from.
    assert caught >= 0.6 * sum(t for _, t in new) and caught >= 0.9 * sum(p for p, _ in new)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "same id"), (None, "no id"), (3, "word " * 50_000), (4, "1" * 300_000 + "a")], "doc_id long, text string")
    for labels in ([], [(1, None), (None, 1), (2, 7)], [(1, 0), (3, 0)], [(1, 1), (3, 0), (3, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores = [r["s"] for r in docs.select(toxicity.score(F.col("text"), model).alias("s")).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    extra = docs.select("*", F.lit(1).alias("y"), F.lit("x").alias("at"), F.lit(2).alias("id"))
    assert toxicity.train(extra, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")).constant is None
    assert [r["t"] for r in docs.where("doc_id = 1").select(toxicity.restored(F.col("text"), model.table).alias("t")).collect()] == [None]
    assert docs.limit(0).select(toxicity.score(F.col("text"), model)).count() == 0


# Hard negatives.


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (70, 64, 129), (33, 40, 35), (0, 4, 3)])
def test_strassen_equals_the_plain_product(shape):
    rng = np.random.default_rng(1)
    n, k, m = shape
    a, b = rng.integers(-(2**30), 2**30, (n, k)), rng.integers(-(2**30), 2**30, (k, m))
    for leaf in (1, 2, 16):
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    big, whole = rng.integers(-(2**62), 2**62, (9, 9)), rng.integers(-1, 2, (9, 9))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in whole.T] for r in big], object)
    fits = np.abs(want.astype(float)) < 2**62
    assert (hard_negatives.strassen(big, whole, 1)[fits] == want[fits].astype(np.int64)).all()


def test_heaps_keep_the_best():
    rng = np.random.default_rng(5)
    owner, score, ids, row = rng.integers(0, 6, 3000), rng.integers(0, 40, 3000), rng.integers(0, 200, 3000), np.arange(3000)
    heaps = hard_negatives.Heaps(6, 5)
    for a in range(0, 3000, 170):
        heaps.push(owner[a : a + 170], score[a : a + 170], ids[a : a + 170], row[a : a + 170])
    every = sorted(zip(owner.tolist(), (-score).tolist(), ids.tolist(), row.tolist(), strict=True))
    want = [e for o in range(6) for e in [x for x in every if x[0] == o][:5]]
    assert [(o, -s, i, r) for o, s, i, r in heaps.entries.tolist()] == want


def plain_negatives(rows):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, vector, label) whose ids differ."""
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v, y in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z == y) for j, w, z in ok if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            found = [(j2, -n) for n, j2, same in scored if not same and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out |= {(i, j, r + 1, j2, -p, n) for r, (j2, n) in enumerate(found)}
    return out


@pytest.mark.parametrize("options", [hard_negatives.MiningOptions(), hard_negatives.MiningOptions(block=2, tile=16, leaf=2)])
def test_hard_negatives_equal_the_plain_version(spark, options):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(6) * 0.3).tolist(), int(rng.integers(0, 3))) for i in range(0, 620)]
    # A third are copies, of several labels; then what takes no part.
    rows += [(i, [0.5] * 6, i % 4) for i in range(1000, 1300)]
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [1.0, float("nan")], 1), (2300, [0.1] * 6, None), (None, [0.2] * 6, 1), (2400, [0.1, 0.2, 0.3], 2), (2401, [0.1, 0.2, 0.3], 2), (2402, [0.1, 0.2, 0.3], 1), (2500, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).select("*", F.lit(1).alias("row"), F.lit(2).alias("v")).repartition(5)
    got = hard_negatives.hard_negatives(df, options).collect()
    assert len(got) > 100 and {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got} == plain_negatives(rows)
    assert len(got) == len(set(got))


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (101, [1.0], 2)], VECTORS)
    assert hard_negatives.hard_negatives(alone).count() == 0
    # Rows that share an id are rows of their own, and each may be an anchor.
    twice = spark.createDataFrame([(100, [1.0], 1), (100, [1.0], 1), (101, [0.9], 2)], VECTORS)
    assert sorted((r["anchor_id"], r["positive_id"], r["negative_id"]) for r in hard_negatives.hard_negatives(twice).collect()) == [(100, 100, 101)] * 2


# Vector codes.


def test_masks_find_the_nearest():
    rng = np.random.default_rng(4)
    for n, dims, spread in ((1, 3, 10), (70, 1, 5), (256, 16, 300), (200, 4, 3), (130, 2, 1 << 25)):
        entries, x = rng.integers(-spread, spread, (n, dims)), rng.integers(-2 * spread, 2 * spread, (300, dims))
        apart = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        entry, best = vector_codes.Masks(entries).nearest(x)
        assert (entry == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_masks_hold_exactly_the_ranges():
    rng = np.random.default_rng(8)
    entries, x = rng.integers(-20, 20, (150, 5)), rng.integers(-25, 25, (40, 5))
    row, e = vector_codes.Masks(entries).within(x, np.full(40, 9))
    want = (np.abs(x[:, None] - entries[None]) <= 9).all(axis=2)
    assert list(zip(row.tolist(), e.tolist(), strict=True)) == list(zip(*(a.tolist() for a in np.nonzero(want)), strict=True))


def plain_codes(rows, entries, rounds, parts=4):
    """(id, code, error, label) and the digest of rows (id, integer vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    edges = vector_codes.bounds(len(rows[0][1]), parts)
    books = [[list(v[a:z]) for _, v, _ in rows[:entries]] for a, z in edges]

    def assign():
        out = []
        for _, v, _ in rows:
            out.append([min((sum((x - y) ** 2 for x, y in zip(v[a:z], e, strict=True)), k) for k, e in enumerate(book)) for book, (a, z) in zip(books, edges, strict=True)])
        return out

    for _ in range(rounds):
        got = assign()
        for p, (a, z) in enumerate(edges):
            for k in range(len(books[p])):
                own = [v[a:z] for (_, v, _), g in zip(rows, got, strict=True) if g[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    coded = [(i, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), y) for (i, _, y), g in zip(rows, assign(), strict=True)]
    return coded, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_vector_codes_equal_the_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.integers(-900, 900, 10).tolist(), None if i % 9 == 0 else int(i % 3)) for i in rng.permutation(150)]
    rows += [(200 + i, [100] * 10, 1) for i in range(80)] + [(5, rng.integers(-900, 900, 10).tolist(), 2), (None, [7] * 10, 0), (None, [9] * 10, None)]
    other = [(300 + i, rng.integers(-9, 9, 3).tolist(), 1) for i in range(4)]
    dropped = [(400, None, 1), (401, [1.0, None], 1), (402, [float("inf")], 1)]
    df = spark.createDataFrame([(i, [x / 1024 for x in v], y) for i, v, y in rows + other] + dropped, VECTORS).select("*", F.lit(1).alias("group"), F.lit(2).alias("v")).repartition(4)
    got = vector_codes.vector_codes(df, vector_codes.CodeOptions(entries=20, rounds=3, batch=64)).collect()
    (first, sha), (second, sha2) = plain_codes(rows, 20, 3), plain_codes(other, 20, 3)
    by_label = Counter()
    for _, _, error, y in first + second:
        by_label[y] += error
    want = Counter((i, code, error, by_label[y], s) for part, s in ((first, sha), (second, sha2)) for i, code, error, y in part)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == want


def test_codes_stand_for_their_entries(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0, 1.0, float(-i)], 1) for i in range(6)], VECTORS)
    options = vector_codes.CodeOptions(rounds=0)
    books = {4: [np.array([[1024 * c] for c in column]) for column in zip(*[(i, 0, 1, -i) for i in range(6)], strict=True)]}
    got = vector_codes.decoded(vector_codes.vector_codes(df, options), books, 4).orderBy("vec_id").collect()
    assert [r["vector"] for r in got] == [[1024 * i, 0, 1024, -1024 * i] for i in range(6)] and all(r["error"] == 0 for r in got)
    assert vector_codes.vector_codes(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30], 1)], VECTORS))
