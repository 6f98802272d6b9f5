"""Operators on small frames with edge cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import hashlib
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import bpe, common, embedding_dedup, fingerprint, langid, minhash, packing, quality, secrets, substring, token_store

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = words(rng, 300)
    w = base.split()
    near = " ".join([*w[:100], "changed", *w[101:]])
    passage = words(rng, 40, 10_000)
    out = [None, "", " \n\t ", "one two", "one two", base, base, near, f"{words(rng, 60)} {passage} tail", f"{passage}\n{words(rng, 50)}", words(rng, 20_000, 50_000), "x " * 200, "ein naïver Text mit Ümlaut und ß. Noch ein Satz!", "日本語 テキスト 　 x"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame([*rows, (None, "a row without an id has words " * 5, None, None, None)], SCHEMA).repartition(3)


def test_near_duplicates_equal_brute_force(docs, texts):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i, _ in texts} == brute.components(texts)
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for i, r in got.items() if i is not None)


def test_near_duplicates_in_blocks_find_the_same(spark):
    rng = random.Random(2)
    base = words(rng, 200, 5000).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, minhash.LinkOptions(block=7)).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


@pytest.mark.parametrize("percent", [50, 65, 80, 85, 95])
def test_tables_follow_the_threshold(percent):
    o = minhash.LinkOptions(percent=percent)
    assert 1 - (1 - (1 - (percent / 100) ** o.half) ** o.side) ** 2 <= 0.002
    assert (minhash.LinkOptions().side, minhash.LinkOptions().half) == (12, 5)


def test_pipeline_links_at_80_percent(spark):
    """Pairs of 0.80 to 0.85: op4 keeps both, the stage of the pipeline one; a pair under 0.80 stays."""
    rng = random.Random(4)
    rows = []
    for i in range(0, 400, 2):
        w = words(rng, 204, 10**9).split()
        # 200 shingles, of which 21 differ at the end: 179 / 221 = 0.81; of the last pair 24: 176 / 224 = 0.79.
        k = 24 if i == 398 else 21
        rows += [(i, " ".join(w), "en", "s", 0), (i + 1, " ".join([*w[:-k], *words(rng, k, 10**9).split()]), "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert minhash.keep_first(df).count() == 400
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    first = brute.components([r[:2] for r in rows], 80)
    assert got == [i for i, (_, c) in first.items() if i == c] == [*range(0, 400, 2), 399]


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(none).count() == 0
    assert substring.digests(none).count() == 0
    assert bpe.digests(none).count() == 0
    assert token_store.digests(none).count() == 0
    assert fingerprint.digests(none).count() == 0
    assert secrets.scan_secrets(none).count() == 0
    assert packing.pack_documents(none, packing.byte_length(F.col("text"))).count() == 0
    assert langid.train(none) is None
    assert none.select(langid.identify(F.col("text"), None)).count() == 0
    assert quality.fit(spark.createDataFrame([], "label int, x array<double>")).constant == 0.5
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("options", [substring.RepeatOptions(), substring.RepeatOptions(hot=1, shard=3), substring.RepeatOptions(window=8, anchor=3)])
def test_repeats_equal_brute_force(docs, texts, options):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs, options).collect()}
    assert {i: got[i] for i, _ in texts} == brute.repeats(texts, options.window)
    assert got[None][1] == 0


def test_windows_of_many_documents_go_to_no_shard(spark, monkeypatch):
    rng = random.Random(8)
    passage = words(rng, 40, 10_000)
    texts = [(i, f"{words(rng, 30, 10**9)} {passage} {words(rng, 30, 10**9)}") for i in range(400)]
    whole = substring.repeats_in_shard

    def bounded(pdf, window):
        assert len(pdf) < 200
        return whole(pdf, window)

    monkeypatch.setattr(substring, "repeats_in_shard", bounded)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(df, substring.RepeatOptions(hot=50, shard=50)).collect()}
    assert got == brute.repeats(texts)


def test_texts_without_repeats_stay_as_they_are(docs, texts):
    got = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()}
    assert got[2] == " \n\t " and got[0] is None and got[13] == texts[13][1]
    assert got[6] == ""


def encoders():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, bpe.tiktoken_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


ODD = ["  a", "a  b\n\n c", "\n", "a\n", "x\n\n\ny z", " \n a", "tab\there", "it's 'quoted' don't  x", "<|endoftext|> a<|endoftext|>", "naïve Ω ß 12345 ½ x²", "a \n b", "é​ z", "\x1c a", "a\xa0b c", "🙂 🙂🙂 a", "a\x0bb", "A.B, c!", "x" * 5000]


@pytest.mark.parametrize("text", ODD)
def test_cached_encoding_equals_the_libraries(text):
    import public_tokenizers

    t, e = encoders()
    assert np.frombuffer(bpe.tokenizers_cached(public_tokenizers.path("byte_bpe_50k.json"))(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.tiktoken_cached(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))(text), "<u4").tolist() == e.encode_ordinary(text)


@pytest.mark.parametrize("options", [bpe.EncodeOptions(), bpe.EncodeOptions(chunk=200, overlap=50)])
def test_bpe_round_trip(docs, texts, options):
    _, e = encoders()
    more = docs.union(docs.where("doc_id in (5, 10)")).union(docs.sparkSession.createDataFrame([(99, "a" * 700 + " " + "b! " * 300 + "   \n" * 100 + "日本語" * 200, "", "", 0)], SCHEMA))
    got = bpe.digests(more, options).collect()
    assert len(got) == more.count()
    want = {r["doc_id"]: r["text"] or "" for r in more.collect()}
    for r in got:
        ids = e.encode_ordinary(want[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_store_reads_back_what_was_written(docs):
    t, _ = encoders()
    more = docs.union(docs.where("doc_id = 5"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in more.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    ids = [t.encode(x, add_special_tokens=False).ids + [2] for _, x in rows]
    starts = np.cumsum([0, *map(len, ids)])
    want = sorted((-1 if k is None else k, int(s), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (k, _), i, s in zip(rows, ids, starts[:-1], strict=True))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.digests(more).collect())
    assert got == want


def test_absent_keys_are_not_found(docs, spark):
    store = token_store.write_store(docs.where("doc_id is not null"))
    asked = spark.createDataFrame([(5, 0), (5, 7), (12345, 0)], "doc_id long, copy int")
    assert [(r["doc_id"], r["copy"]) for r in store.lookup(asked).collect()] == [(5, 0)]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    mph = token_store.PerfectHash(keys)
    assert sorted(mph.slot(keys).tolist()) == list(range(5000))
    packed = mph.pack()
    assert (token_store.PerfectHash.unpack(packed).slot(keys) == mph.slot(keys)).all()
    assert token_store.PerfectHash(np.empty(0, np.uint64)).size == 0


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprint.digests(docs, 4).collect()}
    order = sorted((i for i, _ in texts), reverse=True)
    text = dict(texts) | {None: "a row without an id has words " * 5}
    for i, after in zip([*order, None], [*order[1:], None, order[0]], strict=True):
        own, nxt = text[i] or "", text[after] or ""
        assert got[i]["edited_sha256"] == hashlib.sha256(fingerprint.edited(own, nxt).encode()).hexdigest()
        assert got[i]["n_chars"] == len(own) and 0 <= got[i]["near_edited"] <= 1
    assert got[5]["fingerprint"] == got[6]["fingerprint"] != got[7]["fingerprint"]
    assert got[6]["near_next"] == 1.0 and got[10]["near_edited"] > 0.6
    assert "".join(fingerprint.leaves(text[10])) == text[10]


def test_differing_branches_locate_an_edit():
    rng = random.Random(5)
    a = words(rng, 400)
    at = len(a) // 2
    b = a[:at] + " inserted words here " + a[at:]
    spans = fingerprint.differing(fingerprint.fingerprint(a), fingerprint.fingerprint(b))
    assert spans and all(x - 200 <= at <= y + 200 for x, y in spans)
    assert fingerprint.differing(fingerprint.fingerprint(a), fingerprint.fingerprint(a)) == []


def test_language_edges(spark):
    rows = [(i, x, l, "s", 1) for i, (x, l) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de")] * 20)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    df = spark.createDataFrame([(None,), ("",), ("123 ... ²",), ("the house and the cat",), ("die katze und der hund",), ("x" * 5000,)], "text string")
    got = [tuple(r["g"]) for r in df.select(langid.identify(F.col("text"), model).alias("g")).collect()]
    assert [g[0] for g in got[:5]] == ["und", "und", "und", "en", "de"] and got[0][1] == 0.0
    assert all(0 <= g[1] <= 1 for g in got) and got[5][0] in ("en", "de")


def test_segmentations_are_summed(monkeypatch):
    monkeypatch.setattr(langid, "load_pieces", lambda _: langid.Pieces([b"a", b"b", b"ab"]))
    got = np.exp(langid.word_scores(["ab", "aba"], langid.Model(["x"], np.array([[0.5], [0.3], [0.2]]), "")))[:, 0]
    assert got == pytest.approx([0.5 * 0.3 + 0.2, (0.5 * 0.3 + 0.2) * 0.5])


def test_quality_scores_are_probabilities(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(len(quality.NAMES)) * (1 + k) + 2 * k).tolist()) for k in (0, 1) for _ in range(100)]
    df = spark.createDataFrame(rows, "label int, x array<double>")
    model = quality.fit(df)
    got = df.select("label", quality.score(F.col("x"), model).alias("s")).toPandas()
    assert ((got.s >= 0) & (got.s <= 1)).all() and ((got.s >= 0.5) == (got.label == 1)).mean() > 0.95
    assert quality.fit(df.where("label = 1")).constant == 1.0
    assert all(np.isfinite(quality.statistics(t)).all() for t in (None, "", "a", " \n" * 50, "x" * 100_000))


def test_secrets_and_masks(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY9z"
    rows = ["password = hunter22", "token: ab", f"my {key} here", "AKIA" + "A1" * 10, "a" * 23 + "f", "d41d8cd98f00b204e9800998ecf8427e", "12345678-1234-1234-1234-123456789abc", None, "", "PASSWORD:\"abcdef\" ſecret=abcdefgh", "é token=abcdefg"]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(rows)], SCHEMA)
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    assert got[0]["spans"] == "assign:0:19" and got[1]["spans"] == "" and got[2]["spans"] == f"token:3:{3 + len(key)}"
    assert got[3]["n_access"] == 1 and got[4]["n_hex"] == 1 and got[5]["spans"] == "hex:0:32" and got[6]["n_hex"] == 0
    assert got[7]["base_sha256"] == got[8]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[9]["n_assign"] == 1 and got[10]["spans"] == "assign:2:15"
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[2] == "my <secret> here" and clean[7] is None and clean[1] == "token: ab"


def test_random_strings_of_any_class_are_secrets():
    rng = random.Random(6)
    scanner = secrets.Scanner(secrets.ScanOptions(), common.vocabulary("byte_bpe_50k.tiktoken"))
    for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits):
        for n in (20, 24, 32, 40):
            keys = ["".join(rng.choices(letters, k=n)) for _ in range(100)]
            # One in a hundred may compress well by chance.
            assert sum(scanner.spans(f"my {k} here")[1] == [("token", 3, 3 + n)] for k in keys) >= 97
    parted = "-".join("".join(rng.choices(string.ascii_letters, k=8)) for _ in range(4))
    assert scanner.spans(parted)[1] == [("token", 0, len(parted))]


def test_identifiers_are_no_secrets():
    scanner = secrets.Scanner(secrets.ScanOptions(), common.vocabulary("byte_bpe_50k.tiktoken"))
    for s in ("12345678-1234-1234-1234-123456789abc", "getNumberOfOpenConnections", "number_of_open_connections", "usr/local/share/documents", "ABSTRACT_BASE_CLASS_NAME", "internationalization", "D41D8CD98F00B204E9800998ECF8427E"):
        assert scanner.spans(s)[1] == [], s


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 32))
    near = base[:30] + rng.standard_normal((30, 32)) * 0.2
    v = np.concatenate([base, near, base[:3]]).astype(np.float32)
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)]
    rows += [(200, None, 0), (201, [0.0] * 32, 0), (202, [float("nan")] + [1.0] * 31, 0), (203, [1.0, None] + [1.0] * 30, 0), (204, v[0].tolist(), None), (205, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), embedding_dedup.VectorOptions(block=5)).collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.arange(len(v))[:, None] % 2 == np.arange(len(v)) % 2)
    np.fill_diagonal(near, False)
    found = sum(got[i]["n_links"] for i in range(len(v)))
    assert found >= 0.9 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(v)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 206))


def test_packing_holds_everything(spark):
    rng = random.Random(6)
    rows = [(i, "x" * int(rng.paretovariate(0.7) * 100), "", "", 0) for i in range(400)] + [(None, None, None, None, None), (5, "again", "", "", 0)]
    df = spark.createDataFrame([(k, (t or "")[:60_000] if t else t, *r) for k, t, *r in rows], SCHEMA)
    options = packing.PackOptions(group=64)
    got = packing.pack_documents(df, packing.byte_length(F.col("text")), options).toPandas()
    want = df.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0]
    assert got["size"].sum() == want
    bins = got.groupby("bin_id").agg(used=("size", "sum"), capacity=("capacity", "first"))
    assert (bins.used <= bins.capacity).all() and set(bins.capacity) <= set(options.lengths)
    smaller = bins.capacity.map(lambda c: max([x for x in options.lengths if x < c], default=0))
    assert (bins.used > smaller).all()
    spans = got.sort_values(["bin_id", "offset"])
    assert (spans.groupby("bin_id").offset.shift(-1).dropna() == (spans.offset + spans["size"])[spans.groupby("bin_id").offset.shift(-1).notna()]).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.connected_components(edges, common.Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_marked_rows_hold_all_wanted(spark):
    df = spark.range(5000)
    got, others = common.split_by(df, df.where("id % 50 = 0"), "id")
    ids = {r["id"] for r in got.collect()}
    assert got.count() + others.count() == 5000
    assert set(range(0, 5000, 50)) <= ids and len(ids) < 200


@pytest.mark.parametrize("name", ["op4", "op5", "op10", "op2"])
def test_extra_columns_with_clashing_names(spark, name):
    df = spark.createDataFrame([(1, "a b c d e f g " * 6, 3, "k", 5), (2, "a b c d e f g " * 6, 4, "k", 6)], "doc_id long, text string, id long, key string, n long")
    run = {"op4": minhash.near_duplicates, "op5": substring.digests, "op10": secrets.scan_secrets, "op2": bpe.digests}[name]
    assert run(df).count() == 2
    if name == "op4":
        kept = minhash.keep_first(df)
        assert kept.columns == df.columns and kept.count() == 1
    if name == "op5":
        assert substring.without_repeats(df).columns == df.columns


def test_workers_let_go_of_what_encoding_held():
    from larkspur.llm import bpe, common

    path = common.vocabulary("byte_bpe_50k.json")
    cached = bpe.tokenizers_cached(path)
    assert cached("some words") and len(cached.spaced)
    bpe.release(path)
    assert not len(cached.spaced) and ("json", path) not in bpe._held


def test_decoding_needs_no_encoding_and_words_held_are_bounded():
    path = common.vocabulary("byte_bpe_multi_50k.tiktoken")
    assert bpe.read_ranks(path) == bpe.tiktoken_encoding(path)._mergeable_ranks
    assert bpe.tiktoken_cached(path).spaced.most <= 200_000
    bpe.release(path)


def test_features_join_until_none_is_over_its_penalty():
    """More telling features than 12 rounds would take."""
    from larkspur.llm import toxicity

    n, k = 400, 20
    y = np.arange(n) % 2
    row, at = np.nonzero((y[:, None] == 1) & (np.random.default_rng(1).random((n, k)) < 0.3))
    options = toxicity.FitOptions(together=1, ease=1.0, deviations=0.5, steps=400)
    weights, bias = toxicity.fit_weights(row, at, y, options)
    z = np.bincount(row, weights=weights[at], minlength=n) + bias
    slope = np.abs(np.bincount(at, weights=(1 / (1 + np.exp(-z)) - y)[row], minlength=k)) / n
    penalty = options.deviations * (np.sqrt(np.bincount(at, minlength=k) * 0.25) + 1) / n
    assert (slope[weights[:k] == 0] <= penalty[weights[:k] == 0] + 1e-9).all() and (weights[:k] != 0).sum() > 12
