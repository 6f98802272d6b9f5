"""Byte-level BPE: encoding of whole texts, long ones in overlapping chunks, and decoding.

A long text is cut into chunks that overlap. Every chunk is split into pre-tokens on its own, in parallel. Inside an
overlap both chunks' boundaries fall together after a few pre-tokens, and from such a point on both agree, so the
chunks are stitched there and each piece between two stitches is encoded alone. Ids of the pieces follow each other;
decoding concatenates the raw bytes of the ids. If an overlap of a text has no common boundary (one pre-token longer
than it), only boundaries before white space count in that text, which hold whatever went before, and the chunk before
goes on until the next such stitch; the ids are the same.

Text splits into pre-tokens afresh wherever a white-space character follows another one, so words with the white space
before them can be encoded once and looked up; texts with white space outside ASCII go to the library whole.

Edge cases: a null or empty text has no ids. Lone surrogates can't occur in Spark strings. Repeated rows each give a
row; a null id is kept; an empty table gives no rows. Whether a text is cut into chunks (`EncodeOptions.chunk`) changes
where it is encoded, never its ids. Other columns of the input are left out.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, limit_threads, partitions, slices, tidy, vocabulary

# White space before a word, and the word; or white space at the end.
CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# White space outside ASCII and separators, on which regular expression libraries may differ.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028-\u2029\u202f\u205f\u3000\ufeff]")


# A text without these is words parted by single spaces and line ends, each a pre-token boundary.
UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f")
# Marks that are a pre-token of their own after a word.
MARKS = frozenset(".,;:!?")


class Words(dict):
    """Ids of words, made when first asked for; a full one makes them anew each time."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(self) < self.most and len(word) < 64:
            self[word] = ids
        return ids


class Cached:
    """Encodes texts word by word through bounded caches of the ids' bytes.

    encode is for whole texts, split cuts into pre-tokens, piece encodes one pre-token. Ids are little-endian integers
    of the type `code` of the array module.
    """

    def __init__(self, encode: Callable[[str], list[int]], split: Callable[[str], list[str]], piece: Callable[[str], list[int]], code: str, most: int = 500_000):
        self.encode, self.code = encode, code
        self.dtype = np.dtype({"H": "<u2", "I": "<u4"}[code])
        self.pieces = Words(lambda p: self.raw(piece(p)), most // 4)

        def make(before: str) -> Words:
            def word(w: str) -> bytes:
                # A run of letters, with a space before it or not, is one pre-token.
                if w.isalpha():
                    return self.raw(piece(before + w))
                if w[-1:] in MARKS and w[:-1].isalpha():
                    return words[w[:-1]] + self.pieces[w[-1]]
                return b"".join([self.pieces[p] for p in split(before + w)])

            words = Words(word, most if before else most // 4)
            return words

        self.first, self.spaced = make(""), make(" ")

    def raw(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text."""
        if not text:
            return b""
        if ODD.search(text):
            return self.raw(self.encode(text))
        first, spaced = self.first, self.spaced
        if any(x in text for x in UNEVEN) or text[0] in " \n" or text[-1] in " \n":
            return b"".join(map(first.__getitem__, CHUNK.findall(text)))
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(first[words[0]] + b"".join(map(spaced.__getitem__, words[1:])))
        return first["\n"].join(lines)


_held: dict[tuple, object] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tiktoken_encoding(path: str):
    """The encoding of a file of ranks; one for each Python worker."""
    if ("tiktoken", path) not in _held:
        import public_tokenizers
        import tiktoken

        _held["tiktoken", path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _held["tiktoken", path]


def tiktoken_cached(path: str) -> Cached:
    if ("cached", path) not in _held:
        import public_tokenizers
        import regex

        encoding = tiktoken_encoding(path)
        _held["cached", path] = Cached(encoding.encode_ordinary, regex.compile(public_tokenizers.PATTERN).findall, lambda p: encoding._encode_single_piece(p.encode()), "I", 200_000)
    return _held["cached", path]


def release(path: str) -> None:
    """Let go of a file's tokenizer or ranks and of the words met under it, as far as this worker holds them."""
    _held.pop(("tiktoken", path), None)
    for kind in ("cached", "json"):
        cached = _held.pop((kind, path), None)
        if cached:
            for words in (cached.pieces, cached.first, cached.spaced):
                words.clear()


def byte_spelling() -> dict[int, int]:
    """Byte -> the character that byte-level vocabularies spell it with: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    others = [b for b in range(256) if b not in set(plain)]
    return dict(zip(plain + others, plain + [256 + i for i in range(len(others))], strict=True))


def tokenizers_cached(path: str) -> Cached:
    """The tokenizer of a JSON file. A word's pre-tokens go to its model directly, which skips the library's bookkeeping."""
    if ("json", path) not in _held:
        limit_threads()
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        import public_tokenizers
        import regex

        # The pre-tokens of a byte-level file are those of PATTERN; their bytes are spelt as printable characters.
        model, split, spelt = t.model, regex.compile(public_tokenizers.PATTERN).findall, byte_spelling()

        def whole(text: str) -> list[int]:
            return t.encode(text, add_special_tokens=False).ids

        def piece(p: str) -> list[int]:
            return [x.id for x in model.tokenize(p.encode().decode("latin-1").translate(spelt))]

        kind = json.loads(t.to_str())
        pre = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level file without a normalizer")
        _held["json", path] = Cached(whole, split, piece, "H" if t.get_vocab_size() <= 1 << 16 else "I")
    return _held["json", path]


@dataclass(frozen=True)
class EncodeOptions:
    """chunk: characters of a chunk of a long text; overlap: characters that it shares with the next."""

    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    chunk: int = 32_768
    overlap: int = 512


# A pre-token this near to the end of a chunk might go on in the text.
EDGE = 16


def stitch_points(chunk: str) -> np.ndarray:
    """Ends of pre-tokens of `chunk` that end in no white space, where encoding can be cut without a trace."""
    import public_tokenizers
    import regex

    pattern = _held.setdefault(("pattern",), regex.compile(public_tokenizers.PATTERN))
    ends = (m.end() for m in pattern.finditer(chunk))
    return np.array([e for e in ends if e <= len(chunk) - EDGE and not chunk[e - 1].isspace()], np.int64)


def _boundaries(chunk: Column, overlap: int) -> Column:
    """struct(head, tail, spaced, n): stitch points in the first and the last `overlap` characters of the chunk, counted from where the overlap begins; those of the tail before white space; the chunk's length."""

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for chunks in slices(batches):
            rows = []
            for c in chunks:
                ends = stitch_points(c)
                tail = ends[ends >= len(c) - overlap]
                spaced = np.array([e for e in tail if c[e].isspace()], np.int64)
                rows.append((ends[ends <= overlap], tail - len(c) + overlap, spaced - len(c) + overlap, len(c)))
            yield pd.DataFrame(rows, columns=["head", "tail", "spaced", "n"])

    return F.pandas_udf(run, "head array<long>, tail array<long>, spaced array<long>, n long")(chunk)


def _ids(text: Column, path: str) -> Column:
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tiktoken_cached(path)
        for texts in slices(batches):
            yield pd.Series([encode(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "binary")(text)


def encode_long(docs: DataFrame, options: EncodeOptions, path: str) -> DataFrame:
    """(row, ids) of `docs` (row: a unique key, text), all longer than a chunk."""
    step = options.chunk - options.overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - options.overlap) / step)).cast("int")
    chunks = docs.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    last = F.col("k") == n - 1
    chunks = chunks.select("row", "k", last.alias("last"), F.substring("text", F.col("k") * step + 1, F.when(last, F.length("text")).otherwise(options.chunk)).alias("chunk"))
    split = chunks.repartition(partitions(docs.sparkSession), "row", "k").select("row", "k", "last", "chunk", _boundaries(F.col("chunk"), options.overlap).alias("s"))
    # Where chunk k and the next first agree, in characters from the start of the next; null without agreement.
    order = Window.partitionBy("row").orderBy("k")
    after = F.lead("s.head").over(order)
    stitched = split.withColumn("met", F.array_min(F.array_intersect("s.tail", after))).withColumn("sure", F.array_min(F.array_intersect("s.spaced", after)))
    always = F.min(F.col("last") | F.col("met").isNotNull()).over(Window.partitionBy("row"))
    stitched = stitched.withColumn("end", F.when(F.col("last"), None).when(always, F.col("met")).otherwise(F.col("sure"))).withColumn("begin", F.lag("end").over(order))
    # A chunk without a stitch at its start belongs to the piece before.
    stitched = stitched.withColumn("piece", F.sum(F.when((F.col("k") == 0) | F.col("begin").isNotNull(), 1).otherwise(0)).over(order))
    begin = F.when(F.col("begin").isNotNull(), F.col("begin")).when(F.col("k") == 0, F.lit(0)).otherwise(F.lit(options.overlap))
    end = F.when(F.col("last"), F.col("s.n")).when(F.col("end").isNotNull(), F.col("s.n") - options.overlap + F.col("end")).otherwise(F.col("s.n"))
    parts = stitched.select("row", "piece", "k", F.substring("chunk", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    pieces = parts.groupBy("row", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("text"))
    ids = pieces.repartition(partitions(docs.sparkSession), "row", "piece").select("row", "piece", _ids(F.col("text"), path).alias("ids"))
    # One text's ids, like its row, are held together.
    return ids.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p")).select("row", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def encode(docs: DataFrame, options: EncodeOptions = EncodeOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of `docs`: ids are little-endian unsigned 32-bit integers."""
    path = vocabulary(options.vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= options.chunk).select("doc_id", _ids(F.col("text"), path).alias("ids"))
    # A text and its id name a row; equal rows are encoded once and counted.
    long = rows.where(F.length("text") > options.chunk).withColumn("row", F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2("text", 256)))
    long = cut(long.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").cast("int").alias("times"), F.first("text").alias("text")), "long_texts")
    done = encode_long(long.select("row", "text"), options, path).join(long.select("row", "doc_id", "times"), "row")
    return short.union(done.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "ids"))


def decode(ids: Column, vocabulary_name: str = "byte_bpe_multi_50k.tiktoken") -> Column:
    """The bytes of a column of ids (little-endian unsigned 32-bit integers)."""
    path = vocabulary(vocabulary_name)

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Workers that encoded before are used again; beside those that encode now they need none of what they hold.
        release(path)
        if ("bytes", path) not in _held:
            ranks = read_ranks(path)
            table = [b""] * (max(ranks.values()) + 1)
            for token, k in ranks.items():
                table[k] = token
            _held["bytes", path] = table
        table = _held["bytes", path]
        for many in batches:
            yield pd.Series([b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in many], dtype=object)

    return F.pandas_udf(run, "binary")(ids)


def digests(docs: DataFrame, options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by encoding and decoding each whole text."""
    bound_batches(docs.sparkSession)
    coded = encode(docs, options)
    both = coded.withColumn("decoded", decode(F.col("ids"), options.vocabulary))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

