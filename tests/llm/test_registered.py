"""The registered queries on the smallest tables: against SQL, brute force, the libraries, or held-out accuracy."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import common, queries, secrets

from . import brute


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' order by doc_id").df()


@pytest.fixture(scope="module")
def got(spark, sf):
    held = {}

    def run(name):
        if name not in held:
            held[name] = queries.QUERIES[name](spark, sf).toPandas()
        return held[name]

    return run


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, got, sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got(name).columns)
    key = "vec_id" if "vec_id" in columns else "doc_id"
    assert want[columns].sort_values(key, ignore_index=True).equals(got(name)[columns].sort_values(key, ignore_index=True).astype(want[columns].dtypes))


def test_op1_and_op2_equal_the_libraries(got, docs):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one, two = (got(n).sort_values("doc_id", ignore_index=True) for n in ("op1_token_store", "op2_byte_bpe"))
    start = 0
    for a, b, doc_id, text in zip(one.itertuples(), two.itertuples(), docs.doc_id, docs.text, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (a.doc_id, a.start, a.n_tokens, a.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        ids = e.encode_ordinary(text)
        assert (b.doc_id, b.n_tokens, b.ids_sha256) == (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert b.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op3_held_out_accuracy(got, sf):
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df()
    r = got("op3_quality_rqda").merge(labels, on="doc_id")
    assert (r.held_out == r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert r.score.between(0, 1).all() and (r.predicted == (r.score >= 0.3)).all()
    assert (r[r.held_out].predicted == r[r.held_out].quality).mean() >= 0.9


def test_op7_edited_texts(got, docs):
    r = got("op7_merkle_fingerprint").sort_values("doc_id", ascending=False, ignore_index=True)
    texts = docs.text.to_list()[::-1]
    for i, (a, b) in enumerate(zip(texts, [*texts[1:], texts[0]], strict=True)):
        k = len(a) // 3
        assert r.edited_sha256[i] == hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()
    assert r.near_edited.mean() > 0.55 and r.near_next.mean() < 0.1
    assert len(set(docs.text)) == r.fingerprint.nunique()


def test_op8_held_out_accuracy(got, docs):
    r = got("op8_language_id").merge(docs, on="doc_id")
    assert (r.held_out == r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (r[r.held_out].lang_pred == r[r.held_out].lang).mean() >= 0.95


def test_op10_base_spans(got, docs):
    r = got("op10_secret_scan").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert r.base_sha256[i] == hashlib.sha256(brute.base_spans(t).encode()).hexdigest()


def test_pipeline_equals_brute_force(spark, sf, docs):
    """Groups, passages and sizes by brute force. test_plain has the language stage and the token spans in plain versions."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(common.vocabulary("byte_bpe_50k.json"))
    encode.encode_special_tokens = True
    r = corpus_pipeline.run(spark, sf).toPandas()
    scanner = secrets.Scanner(secrets.ScanOptions(), common.vocabulary("byte_bpe_50k.tiktoken"))
    texts = [(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True) if any(c.isalpha() for c in t)]
    first = brute.components(texts, 80)
    texts = [(i, t) for i, t in texts if first[i][1] == i]
    kept = brute.kept_words(texts)
    want = {}
    for i, t in texts:
        w, gone = kept[i]
        t = b" ".join(x for j, x in enumerate(w) if j not in gone).decode() if gone else t
        spans = [tuple(map(int, x.split(":")[1:])) for x in brute.base_spans(t).split(",") if x]
        spans += [(a, b) for k, a, b in scanner.spans(t)[1] if k == "token"]
        # Spans that lie on each other are masked together.
        hidden = {j for a, b in spans for j in range(a, b)}
        starts = {j for j in hidden if j - 1 not in hidden} | {a for a, _ in spans if not any(x < a < y for x, y in spans)}
        masked = "".join("<secret>" if j in starts else "" if j in hidden else c for j, c in enumerate(t))
        want[i] = len(encode.encode(masked, add_special_tokens=False).ids) + 1
    assert r.groupby("doc_id")["size"].sum().to_dict() == want


def test_stages_return_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
