"""Operators without SQL against plain versions, and recall of those that search."""

from __future__ import annotations

import base64
import hashlib
import math
import pickle
import random
import string

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import bpe, common, embedding_dedup, fingerprint, langid, minhash, packing, quality, queries, secrets, substring, token_store
from larkspur.llm.fm_index import FMIndex
from larkspur.llm.words import hash_texts

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' order by doc_id").df()


def vocabulary_pieces():
    with open(common.vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f]


def test_word_hashes_tell_words_apart():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a b a", "\x1ca \xa0b", "x" * 600_000 + " y", *(" ".join("".join(rng.choices("abcé", k=rng.randrange(1, 5))) for _ in range(50)) for _ in range(20))]
    h, begin = hash_texts(texts)
    seen = {}
    for i, t in enumerate(texts):
        own = (t or "").encode().split()
        assert begin[i + 1] - begin[i] == len(own)
        for w, x in zip(own, h[begin[i] : begin[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert (hash_texts(["A Bc É"], lower=True)[0] == hash_texts(["a bc É"])[0]).all()


# Language ID.


@pytest.mark.parametrize("word", [" a", "straße", " internationalisation" * 10, "中文没有空格的句子" * 8, "x" * 200])
def test_forward_equals_the_plain_sum(word):
    pieces = vocabulary_pieces()
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    got = langid.word_scores([word, "other"], langid.Model(["x", "y"], p, common.vocabulary("byte_bpe_multi_50k.tiktoken")))[0]
    assert got == pytest.approx([brute.log_probability(word.encode(), dict(zip(pieces, p[:, k].tolist(), strict=True))) for k in (0, 1)])


def test_words_of_any_length_do_not_underflow():
    pieces = vocabulary_pieces()
    p = np.full((len(pieces), 1), 1 / len(pieces))
    at = lambda n: langid.word_scores(["語" * n], langid.Model(["x"], p, common.vocabulary("byte_bpe_multi_50k.tiktoken")))[0, 0]
    assert np.isfinite(at(5000)) and at(5000) - at(4000) == pytest.approx(at(4000) - at(3000))


def test_expected_counts_equal_enumeration():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b" ", b" a"]
    p = dict(zip(pieces, [0.2, 0.1, 0.3, 0.1, 0.1, 0.1, 0.1], strict=True))
    words, n = [b"ababa", b" aab", b"b"], [3.0, 1.0, 2.0]
    want = dict.fromkeys(pieces, 0.0)
    for w, k in zip(words, n, strict=True):
        ways = brute.segmentations(w, p)
        weight = [math.prod(p[x] for x in way) for way in ways]
        for way, v in zip(ways, weight, strict=True):
            for x in way:
                want[x] += k * v / sum(weight)
    got = langid.expected_counts(words, np.array(n), np.array(list(p.values())), langid.Pieces(pieces))
    assert dict(zip(pieces, got.tolist(), strict=True)) == pytest.approx(want)


def test_words_keep_their_space_and_long_texts_are_cut_before_one():
    assert langid.words_of("Der  Hund, x² 12 a_b\nÉté") == ["der", " hund", " x", " a", "b", "été"]
    text = "ab cd " * 5000
    assert "".join(langid.parts_of(text, 100)) == text and all(p.startswith(" ") for p in list(langid.parts_of(text, 100))[1:])
    assert sum((langid.words_of(p) for p in langid.parts_of(text, 100)), []) == langid.words_of(text)


def plain_language(text, model, p):
    """(language, score) by plain sums; p: of each language its pieces' probabilities."""
    words = langid.words_of(text or "")
    if not words:
        return "und", 0.0
    total = [sum(q.setdefault(("word", w), brute.log_probability(w.encode(), q)) for w in words) for q in p]
    best = max(range(len(total)), key=lambda k: total[k])
    return model.languages[best], 1 / sum(math.exp((t - total[best]) / math.sqrt(len(words))) for t in total)


@pytest.fixture(scope="module")
def languages(spark, sf, docs):
    """doc_id -> (language, score), by plain sums under the pipeline's model."""
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    p = [dict(zip(vocabulary_pieces(), model.p[:, k].tolist(), strict=True)) for k in range(len(model.languages))]
    return {i: plain_language(t, model, p) for i, t in zip(docs.doc_id, docs.text, strict=True)}


def test_language_stage_equals_plain_sums(spark, sf, languages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf).collect()}
    assert got == {i for i, (lang, score) in languages.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    scored = docs.select("doc_id", langid.identify(F.col("text"), langid.train(docs)).alias("g")).collect()
    for r in scored:
        assert (r["g"]["lang_pred"], pytest.approx(r["g"]["score"])) == languages[r["doc_id"]]


# Quality.


def test_quality_equals_plain_densities(spark, sf):
    x = np.array([quality.statistics(t) for t in duckdb.sql(f"select text from '{sf}/documents.parquet' join '{sf}/labels.parquet' using (doc_id) order by doc_id").df().text])
    y = duckdb.sql(f"select quality from '{sf}/labels.parquet' join '{sf}/documents.parquet' using (doc_id) order by doc_id").df().quality.to_numpy()
    model = quality.fit(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "label int, x array<double>"))
    got = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>").select("i", quality.score(F.col("x"), model).alias("s")).orderBy("i").toPandas().s
    o = quality.FitOptions()
    z = (x - x.mean(axis=0)) / x.std(axis=0).clip(10**-4.5)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * covs[k] for k in (0, 1))
    density = []
    for k in (0, 1):
        c = (1 - o.to_pooled) * covs[k] + o.to_pooled * pooled
        c = (1 - o.to_diagonal) * c + o.to_diagonal * np.diag(np.diag(c)) + o.ridge * np.eye(len(c))
        d = z - z[y == k].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log((y == k).sum()))
    assert got.to_numpy() == pytest.approx(1 / (1 + np.exp(-(density[1] - density[0]) / o.temperature)), abs=1e-6)


# Fingerprints.


def test_fingerprints_equal_the_plain_tree(spark, sf, docs):
    ends = lambda w: xxhash.xxh3_64_intdigest(w.encode()) % 4 == 0
    plain = lambda t: brute.tree(t, xxhash.xxh3_128_digest, ends)

    def drawn(t):
        sections = plain(t)
        root = hashlib.blake2b(b"".join(top for top, _ in sections), digest_size=16).hexdigest()
        return ";".join([root, *(f"{top.hex()}[{','.join(f'{h[:4].hex()}:{n}' for h, n in s)}]" for top, s in sections)])

    got = {r["doc_id"]: r for r in queries.op7_merkle_fingerprint(spark, sf).collect()}
    rows = list(zip(docs.doc_id[::-1], docs.text[::-1], strict=True))
    for (i, a), (_, b) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(a) // 3
        e = a[: len(a) - k] + b[:k]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (drawn(a), drawn(e))
        for near, other in (("near_edited", e), ("near_next", b)):
            want = 1.0 if a == other else min(brute.shared_weight(plain(a), plain(other)), 0.999999)
            assert got[i][near] == pytest.approx(want)
            assert fingerprint.likeness(drawn(a), drawn(other)) == pytest.approx(want)


def test_short_texts_have_several_leaves():
    a = "a short text of some twelve words that is edited at its end"
    b = fingerprint.edited(a, "quite another text follows here")
    assert fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)) > 0.5


def test_roots_come_from_the_children():
    a, b = fingerprint.Tree("one two three\nfour five " * 30), fingerprint.Tree("one two three\nfour five " * 29 + "one two three\nfour six ")
    assert a.root != b.root
    assert a.root == hashlib.blake2b(b"".join(bytes.fromhex(t) for t, _ in a.sections), digest_size=16).hexdigest()


# Packing.


def test_packing_is_near_the_optimum():
    rng = random.Random(3)
    options = packing.PackOptions(lengths=(8, 16, 32), overhead=1)
    cost = best = 0
    for _ in range(60):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 8))]
        bins, offsets, capacity = packing.pack(np.array(sizes), options)
        own = sum({b: c + options.overhead for b, c in zip(bins.tolist(), capacity.tolist(), strict=True)}.values())
        least = brute.least_packing(sizes, options.lengths, options.overhead)
        assert least <= own <= 1.5 * least
        cost, best = cost + own, best + least
    assert cost <= 1.06 * best


def test_op9_counts_tokens(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = queries.op9_best_fit_packing(spark, sf).toPandas()
    assert got.groupby("doc_id")["size"].sum().to_dict() == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in zip(docs.doc_id, docs.text, strict=True)}
    bins = got.groupby("bin_id").agg(used=("size", "sum"), capacity=("capacity", "first"))
    assert (bins.used <= bins.capacity).all() and set(bins.capacity) <= {2048, 4096, 8192, 16384}


# Secrets.


def test_base_spans_equal_a_plain_scan(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.op10_secret_scan(spark, sf).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert got[i]["base_sha256"] == hashlib.sha256(brute.base_spans(t).encode()).hexdigest()
    for t in ("password=ab token=abcdefg", "PassWD' : \"a1b2c3d4\"", "apikey==abcdef", "api_key:abc api-key:abcdef", "secrettoken=abcdef1", "AKIAAKIA" + "B" * 12, "AKIA1 AKIA" + "C" * 16, "é" + "0a" * 12 + "g" + "f" * 23, "token=\n abcdef", "ſecret=abcdef toKen=abcdef"):
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.base_spans(t)) == brute.base_spans(t), t


def made_keys(rng):
    """kind -> keys."""
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    both, raw = string.ascii_letters + string.digits, lambda n: bytes(rng.randrange(256) for _ in range(n))
    make = {
        "lower case": lambda: pick(string.ascii_lowercase, 24), "letters": lambda: pick(string.ascii_letters, 24), "base 62": lambda: pick(both, 40), "base 32": lambda: base64.b32encode(raw(20)).decode(),
        "base 64": lambda: base64.b64encode(raw(24)).decode(), "base 64 of URLs": lambda: base64.urlsafe_b64encode(raw(33)).decode(), "with a prefix": lambda: "sk_live_" + pick(both, 24),
    }
    return {k: [f() for _ in range(200)] for k, f in make.items()}


def harmless(rng):
    """kind -> runs of words as they stand in code and in paths."""
    words = [w[1:].decode() for w in vocabulary_pieces() if w.startswith(b" ") and w[1:].isalpha() and w[1:].islower() and len(w) >= 5]
    make = {
        "camel case": lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), "joined by _": "_".join, "joined by -": "-".join, "paths": "/".join, "constants": lambda w: "_".join(w).upper(), "run together": "".join,
    }
    return {k: [x for x in (f(rng.sample(words, 4)) for _ in range(200)) if len(x) >= 20] for k, f in make.items()}


def shares(scanner, kinds):
    return {k: sum(any(s[0] == "token" for s in scanner.spans(f"see {x} here")[1]) for x in xs) / len(xs) for k, xs in kinds.items()}


def test_keys_are_found_and_words_are_not():
    rng = random.Random(9)
    scanner = secrets.Scanner(secrets.ScanOptions(), common.vocabulary("byte_bpe_50k.tiktoken"))
    assert min(shares(scanner, made_keys(rng)).values()) >= 0.97
    assert max(shares(scanner, harmless(rng)).values()) <= 0.05


def test_token_spans_equal_a_plain_scan():
    """A run is reported just if it is long, apart from base spans, has few characters a token, and no known form."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(common.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rng = random.Random(10)
    scanner = secrets.Scanner(secrets.ScanOptions(), common.vocabulary("byte_bpe_50k.tiktoken"))
    allowed = set(string.ascii_letters + string.digits + "+/_=-")
    for kind, xs in (made_keys(rng) | {"words": harmless(rng)["run together"]}).items():
        text = "; ".join(xs)
        want, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in allowed:
                j += 1
            if j - i >= 20 and j - i <= 2 * len(e.encode_ordinary(text[i:j])):
                want.append((i, j))
            i = j + 1
        assert [(a, b) for k, a, b in scanner.spans(text)[1] if k == "token"] == want, kind


# Substring dedup.


def test_fm_index_equals_brute_force():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 4, 600)
    symbols[::47] = 0
    symbols[-1] = 0
    index = FMIndex(symbols, 5)
    units = "".join(map(chr, symbols + 64))
    ends = np.array([e for e in range(1, 600) if symbols[e - 1]])
    for others in (False, True):
        length, low, high = index.matching(symbols, ends, 9, np.full(len(ends), others))
        assert (index.locate(np.arange(index.size)) >= 0).all() and sorted(index.locate(np.arange(index.size))) == list(range(600))
        first = index.earliest(low, high)
        for e, n, a, z, f in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist(), first.tolist(), strict=True):
            at = [units[e - k : e] for k in range(10)]
            many = lambda s: sum(units.startswith(s, i) for i in range(600))  # noqa: E731, B023
            assert n == max(k for k in range(10) if "@" not in at[k] and k <= e and many(at[k]) >= 1 + others)
            if n:
                assert (z - a, f) == (many(at[n]), units.find(at[n]))


def test_every_repeat_comes_from_an_index(spark, sf, monkeypatch):
    """Without the indexes' reports nothing is removed."""
    whole, copied = substring.repeats_in_shard, substring.copies_in_shard
    monkeypatch.setattr(substring, "repeats_in_shard", lambda pdf, window: whole(pdf, window).iloc[:0])
    monkeypatch.setattr(substring, "copies_in_shard", lambda index, copies, window: copied(index.iloc[:0], copies, window))
    assert substring.digests(spark.read.parquet(f"{sf}/documents.parquet")).agg(F.sum("n_removed")).first()[0] == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(11)
    make = lambda: [f"w{rng.randrange(10**9)}" for _ in range(120)]
    a, b = make(), make()
    near = lambda w: " ".join([*w[:60], "new", *w[61:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(make())), (4, " ".join(make())), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4)]
    removed = substring.digests(df.union(df.where("doc_id = 2"))).collect()
    assert sorted((r["doc_id"], r["n_words"] - r["n_removed"]) for r in removed if r["doc_id"] in (2, 3)) == [(2, 1), (2, 1), (3, 1)]
    assert [r["n_removed"] for r in substring.digests(spark.createDataFrame([(1, " ".join(a))] * 2, "doc_id long, text string")).collect()] == [0, 0]


# Near vectors.


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_vectors_at_the_threshold_are_found(spark, shift):
    """2,000 pairs at a cosine of 0.930 to 0.932, of centred vectors and of vectors with a common direction."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((2000, 32))
    base[:, 0] += shift
    base /= np.linalg.norm(base, axis=1)[:, None]
    w = rng.standard_normal(base.shape)
    w -= (w * base).sum(axis=1)[:, None] * base
    w /= np.linalg.norm(w, axis=1)[:, None]
    c = rng.uniform(0.9301, 0.932, 2000)[:, None]
    v = np.concatenate([base, c * base + np.sqrt(1 - c**2) * w])
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v) if i < 2000] + [(i, x.tolist(), (i - 2000) % 3) for i, x in enumerate(v) if i >= 2000]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    label = np.array([r[2] for r in rows])
    want = ((v @ v.T >= 0.93) & (label[:, None] == label)).sum(axis=1) - 1
    found = np.array([got[i] for i in range(4000)])
    assert (found <= want).all() and want.sum() >= 4000 and found.sum() >= 0.99 * want.sum()


def test_vectors_of_several_dimensions_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = []
    for dim, n in ((8, 60), (3, 20), (1, 6), (16, 30)):
        for _ in range(n):
            v = rng.standard_normal(dim)
            rows += [(v + 0.15 * rng.standard_normal(dim)).tolist() for _ in range(2)]
    table = [(i, v, i % 2 if i % 11 else None) for i, v in enumerate(rows)] + [(900, rows[61], 0), (901, rows[121], 1), (902, [], 0), (903, None, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "v"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as from '{tmp_path}/v/*.parquet'")
    want = {r[0]: r[1:] for r in c.sql(embedding_dedup.ORACLE).fetchall()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {k: tuple(want[k]) for k in want}


def test_vectors_that_share_an_id(spark):
    v = np.random.default_rng(8).standard_normal((2, 16)).tolist()
    near = (np.array(v) + 0.05).tolist()
    df = spark.createDataFrame([(1, v[0], 0), (1, v[1], 0), (2, near[0], 0), (3, near[1], 0), (4, v[0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


# All of them: names that clash, empty tables, places to write to.

CLASH = ["N_Words", "n_removed", "kept", "_word", "_map", "_ID", "_spans", "_kept", "_Lang", "_doc", "id", "key", "n", "found", "component", "label", "file", "shard"]


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def test_columns_with_any_name_pass_the_stages(spark):
    df = clashing(spark.createDataFrame([(i, "the cat and the dog of the house near the old bridge " * 8, "en", "s", 5) for i in range(3)] + [(7, None, None, None, None), (None, "the words of no one", "en", "s", 1)], SCHEMA))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, "")
        assert got.columns == df.columns and got.count() > 0, name
        assert got.where("n_removed <> 1 or `_map` <> 4").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == 5
    for run in (minhash.near_duplicates, substring.digests, substring.remove_repeats, secrets.scan_secrets, bpe.digests, token_store.digests, fingerprint.digests):
        assert run(df).count() == 5, run
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.near_vectors(vectors.select("*", F.lit(1).alias("unit"), F.lit(2).alias("id"), F.lit(3).alias("keys"))).agg(F.sum("n_links")).first()[0] == 2


def test_queries_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in (queries.QUERIES | {"pipeline": corpus_pipeline.run}).items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_intermediate_tables_go(spark):
    import os

    df = spark.createDataFrame([(i, f"some words that repeat in each text {'and so on ' * 10}") for i in range(4)], "doc_id long, text string")
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert substring.digests(df).count() == 4 and minhash.near_duplicates(df).count() == 4
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"spans", "groups"}


def test_each_language_is_learnt_however_many_there_are(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 4} wörd", f"l{i:03}") for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.FitOptions(sample=40, rounds=1))
    assert model.languages == sorted({r[2] for r in rows})


def test_scans_take_linear_time():
    import time

    scanner = secrets.Scanner(secrets.ScanOptions(), common.vocabulary("byte_bpe_50k.tiktoken"))
    one = "password = abcdef1 and constant_words_joined_together_here;\n" * 2000

    def took(text):
        began = time.process_time()
        assert len(scanner.spans(text)[0]) == text.count("password")
        return time.process_time() - began

    took(one)
    assert min(took(8 * one) for _ in range(3)) < 16 * min(took(one) for _ in range(3)) + 0.1


def shard_of(rng, n=40, words=30):
    units = [rng.integers(0, 2**32, words, dtype=np.uint32) for _ in range(n)]
    return pd.DataFrame({"id": np.arange(n) * 10, "start": 5, "words": [u.tobytes() for u in units]})


def test_copies_go_by_their_words_not_by_their_hash():
    """A copy whose words differ, though it was dealt as a copy, is kept; so is one at an earlier place."""
    rng = np.random.default_rng(1)
    firsts = shard_of(rng)
    index = pd.DataFrame({"index": [pickle.dumps(substring._shard(firsts))]})
    copies = firsts.assign(id=firsts["id"] + 1000)
    got = substring.copies_in_shard(index, copies, 20)
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(i * 10 + 1000, 5, 15) for i in range(40)]
    # One word of each copy is another, at place k: windows that don't hold it are still in the index.
    for k in (0, 14, 15, 29):
        broken = []
        for w in copies["words"]:
            u = np.frombuffer(w, np.uint32).copy()
            u[k] ^= 1
            broken.append(u.tobytes())
        got = substring.copies_in_shard(index, copies.assign(words=broken), 20)
        want = {0: (6, 15), 29: (5, 14)}.get(k)
        assert len(got) == (40 if want else 0) and (not want or set(zip(got["a"], got["b"], strict=True)) == {want})
    same = substring.copies_in_shard(index, firsts, 20)
    before = substring.copies_in_shard(index, copies.assign(id=-5), 20)
    assert len(same) == len(before) == 0
    # Words that no segment has, though as many.
    assert len(substring.copies_in_shard(index, shard_of(rng).assign(id=9999), 20)) == 0


def test_hot_passages_are_streamed_by_many_tasks(spark, monkeypatch):
    rng = random.Random(12)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    texts = [(i, f"{' '.join(f'w{rng.randrange(10**9)}' for _ in range(25))} {passage} end{i}") for i in range(300)]
    whole = substring.copies_in_shard

    def bounded(index, copies, window):
        assert len(copies) < 150
        return whole(index, copies, window)

    monkeypatch.setattr(substring, "copies_in_shard", bounded)
    got = substring.digests(spark.createDataFrame(texts, "doc_id long, text string"), substring.RepeatOptions(stream=50)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute.repeats(texts)
