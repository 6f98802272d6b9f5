"""Language identification by unigram pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A text's words are its runs of letters,
lower-cased, each with the space before it, as the vocabulary spells them. A word's probability is the sum, over all
ways to cut its UTF-8 bytes into pieces of any length, of the product of the pieces' probabilities; a forward pass over
the bytes computes it, scaled as it goes, so a word may have any length. A text's score is the product over its words.
The vocabulary holds every single byte, so each text has a segmentation in each language. Pieces that no lower-cased
run of letters can contain keep the probability that smoothing gives them.

Probabilities are fitted by expectation maximisation on a bounded sample of labelled documents (`FitOptions.sample`).
Spark sums the sample's words by language and, in each round, the expected counts of pieces; what reaches the driver is
a number for each language and piece.

The model has a column for each language, so it and what a round broadcasts grow with the number of languages, never
with the rows. Each language that has a labelled letter is learnt, however many there are.

Edge cases: a text that is null or has no letter is `und` with score 0. Ties go to the language that sorts first.
Without any labelled text every text is `und`. Repeated rows each count and each give a row; an empty table gives no
rows. Very long texts are scored whole, in parts that end before a space. A column of the input may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, cut, fresh, slices, tidy, vocabulary
from .words import BACK, BYTES, GOLD, mix, powers

UNKNOWN = "und"
WORD = re.compile(r" ?[^\W\d_]+")


@dataclass(frozen=True)
class FitOptions:
    """vocabulary: file of pieces. sample: labelled documents, about, by a hash of their id; one of each language at least. rounds: of EM. smoothing: added to each piece's expected count."""

    vocabulary: str = "byte_bpe_multi_50k.tiktoken"
    sample: int = 4000
    rounds: int = 3
    smoothing: float = 0.5


class Pieces:
    """A vocabulary whose pieces are found in words by hashes of byte runs, length by length."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.longest, self.by_length = len(pieces), max(map(len, pieces)), {}
        size = np.array([len(p) for p in pieces])
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            raw = np.frombuffer(b"".join(pieces[i] for i in own.tolist()), np.uint8)
            h = _run_hashes(raw, np.arange(len(own)) * k, k)
            order = np.argsort(h)
            self.by_length[k] = h[order], own[order]

    def find(self, words: list[bytes]) -> Lattice:
        """All pieces at all places of `words`, none of which is empty."""
        size = np.array([len(w) for w in words])
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        room = (begin + size)[word] - np.arange(len(raw))
        hash_of = _run_hashes_of(raw)
        starts, lengths, ids = [], [], []
        for k, (hashes, own) in self.by_length.items():
            at = np.flatnonzero(room >= k)
            if not len(at):
                break
            h = hash_of(at, k)
            slot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[slot] == h
            starts.append(at[hit])
            lengths.append(np.full(int(hit.sum()), k))
            ids.append(own[slot[hit]])
        start, length, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)
        owner = word[start]
        step = start - begin[owner] + length
        order = np.lexsort((owner, step))
        return Lattice(size, begin + np.arange(len(words)), step[order], owner[order], length[order], piece[order])


def _run_hashes_of(raw: np.ndarray):
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * powers(GOLD, len(raw))[:-1], dtype=np.uint64)])
    down = powers(BACK, len(raw))
    return lambda first, k: mix((total[first + k] - total[first]) * down[first] + np.uint64(k))


def _run_hashes(raw: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    return _run_hashes_of(raw)(first, k)


@dataclass
class Lattice:
    """Words and the pieces in them, by step (bytes up to the piece's end) and word. Word i has size[i] + 1 nodes from node[i] on."""

    size: np.ndarray
    node: np.ndarray
    step: np.ndarray
    owner: np.ndarray
    length: np.ndarray
    piece: np.ndarray

    # Steps between two scalings: the least probability of a piece to this power is still a normal number.
    EVERY = 12

    def forward(self, p: np.ndarray, longest: int, shares: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(log of the sum over segmentations, of each word and column of p; with `shares` of each piece in the lattice its share of what ends there).

        p: probability of each piece (row) in each language (column).
        """
        alpha = np.zeros((int((self.size + 1).sum()), p.shape[1]))
        alpha[self.node] = 1.0
        log = np.zeros((len(self.size), p.shape[1]))
        share = np.empty((len(self.step), p.shape[1])) if shares else None
        end = self.node[self.owner] + self.step
        cuts = np.flatnonzero(np.diff(self.step, prepend=0, append=self.step[-1] + 1))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            t, owner = int(self.step[a]), self.owner[a:z]
            into = alpha[end[a:z] - self.length[a:z]] * p[self.piece[a:z]]
            head = np.flatnonzero(np.diff(owner, prepend=-1))
            total = np.add.reduceat(into, head, axis=0)
            if shares:
                share[a:z] = into / np.repeat(total, np.diff(np.append(head, z - a)), axis=0)
            at = end[a:z][head]
            alpha[at] = total
            if t % self.EVERY == 0:
                for j in range(min(longest, t) + 1):
                    alpha[at - j] /= total
                log[owner[head]] += np.log(total)
        return log + np.log(alpha[self.node + self.size]), share

    def expected(self, share: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Expected count of each of n pieces, of words that occur `weight` times; share: of one language."""
        reach = np.zeros(int((self.size + 1).sum()))
        reach[self.node + self.size] = weight
        end = self.node[self.owner] + self.step
        flow = np.empty(len(self.step))
        cuts = np.flatnonzero(np.diff(self.step, prepend=0, append=self.step[-1] + 1))
        for a, z in zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True):
            flow[a:z] = reach[end[a:z]] * share[a:z]
            # Pieces that end at one step of one word begin at different places.
            reach[end[a:z] - self.length[a:z]] += flow[a:z]
        return np.bincount(self.piece, weights=flow, minlength=n)


_held: dict[str, Pieces] = {}


def load_pieces(path: str) -> Pieces:
    """All pieces of a file of ranks; one table for each Python worker."""
    if path not in _held:
        with open(path, "rb") as f:
            _held[path] = Pieces([base64.b64decode(line.split()[0]) for line in f])
    return _held[path]


def release() -> None:
    """Let go of the table of pieces: workers outlive the stage that needs it."""
    _held.clear()


def parts_of(text: str | None, chars: int = 1 << 20) -> Iterator[str]:
    """The text in parts of `chars` characters and the rest of the word there, each but the first beginning with a space."""
    a = 0
    while text and a < len(text):
        z = text.find(" ", a + chars) if len(text) - a > chars else -1
        yield text[a : z if z > 0 else len(text)]
        a = z if z > 0 else len(text)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, each with the space before it, if there is one."""
    words = WORD.findall(text.lower())
    # Runs may hold numerals that are neither digits nor letters.
    return [w for w in (w if w.lstrip(" ").isalpha() else "".join(c for c in w if c == " " or c.isalpha()) for w in words) if w.strip(" ")]


def by_length(words: list[bytes], most: int = 1 << 15) -> Iterator[np.ndarray]:
    """Positions of words, shortest first, in runs of about `most` bytes."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // most)) + 1
    return iter(np.split(order, cuts)) if len(words) else iter(())


@dataclass
class Model:
    """p: probability of each piece (row of the vocabulary's file) in each language (column)."""

    languages: list[str]
    p: np.ndarray
    vocabulary: str


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """log P(word | language), shape (words, languages)."""
    pieces, raw = load_pieces(model.vocabulary), [w.encode() for w in words]
    out = np.zeros((len(words), len(model.languages)))
    for at in by_length(raw):
        out[at] = pieces.find([raw[i] for i in at.tolist()]).forward(model.p, pieces.longest)[0]
    return out


def expected_counts(words: list[bytes], n: np.ndarray, p: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected count of each piece in words of one language, word i being there n[i] times."""
    out = np.zeros(pieces.n)
    for at in by_length(words):
        lattice = pieces.find([words[i] for i in at.tolist()])
        out += lattice.expected(lattice.forward(p[:, None], pieces.longest, shares=True)[1][:, 0], n[at], pieces.n)
    return out


def sampled(labelled: DataFrame, options: FitOptions, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text): of each language documents with the smallest hashes of their ids, about as many of each and one at least.

    Documents without a letter teach nothing and are not drawn.
    """
    usable = F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")
    rows = labelled.where(usable).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("first")).collect()
    if not sizes:
        return rows.select("lang", "text").limit(0)
    # A hash bound from the size of each language, never under its first hash: a sample without a window over a hot
    # language, bounded by `sample` and one document of each language.
    share, top = options.sample / len(sizes), float(2**63)
    bounds = labelled.sparkSession.createDataFrame([(r["lang"], max(float(r["first"]), -top + 2 * top * min(1.0, share / r["n"]))) for r in sizes], "lang string, bound double")
    return rows.join(F.broadcast(bounds), "lang").where(F.col("h").cast("double") <= F.col("bound")).select("lang", "text")


def train(labelled: DataFrame, options: FitOptions = FitOptions(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on `labelled` (id, text, lang); null when it has no labelled word."""
    spark, path = labelled.sparkSession, vocabulary(options.vocabulary)

    @tidy
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: dict[tuple[str, str], int] = {}

        def rows() -> pd.DataFrame:
            lang, word = (pd.Series(x, dtype=object) for x in ([k[0] for k in tally], [k[1].encode() for k in tally]))
            return pd.DataFrame({"lang": lang, "word": word, "n": pd.Series(list(tally.values()), dtype="int64")})

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for part in parts_of(text):
                    for w in words_of(part):
                        tally[lang, w] = tally.get((lang, w), 0) + 1
                    if len(tally) > 200_000:
                        yield rows()
                        tally = {}
        yield rows()

    with Scratch(spark) as scratch:
        tally = sampled(labelled, options, id_col, text_col, lang_col).mapInPandas(split, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        tally = cut(tally, "tally", scratch)
        languages = sorted(r["lang"] for r in tally.select("lang").distinct().collect())
        if not languages:
            return None
        size = load_pieces(path).n
        p = np.full((size, len(languages)), 1.0 / size)
        for _ in range(options.rounds):
            shared = spark.sparkContext.broadcast(p)

            @tidy
            def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                pieces, sums = load_pieces(path), {}
                for pdf in batches:
                    for lang, own in pdf.groupby("lang"):
                        more = expected_counts(list(own["word"]), own["n"].to_numpy(float), shared.value[:, languages.index(lang)], pieces)
                        sums[lang] = sums.get(lang, 0) + more
                for lang, v in sums.items():
                    yield pd.DataFrame({"lang": languages.index(lang), "piece": np.flatnonzero(v), "v": v[v != 0]})

            got = tally.mapInPandas(expect, "lang int, piece int, v double").groupBy("lang", "piece").agg(F.sum("v").alias("v")).toPandas()
            expected = np.full(p.shape, options.smoothing)
            expected[got["piece"], got["lang"]] += got["v"]
            p = expected / expected.sum(axis=0)
            shared.unpersist()
    return Model(languages, p, path)


class Scorer:
    """Keeps the scores of words that one task has met, up to a bound."""

    def __init__(self, model: Model, most: int = 120_000):
        self.model, self.most = model, most
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def _add(self, held: list[tuple[int, list[str]]], total: np.ndarray) -> None:
        if len(self.at) > self.most:
            self._forget()
        new = [w for w in dict.fromkeys(w for _, ws in held for w in ws) if w not in self.at]
        if new:
            self.scores = np.concatenate([self.scores, word_scores(new, self.model)])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        for i, ws in held:
            total[i] += self.scores[np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))].sum(axis=0)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total, n = np.zeros((len(texts), len(self.model.languages))), [0] * len(texts)
        held, chars = [], 0
        for i, text in enumerate(texts):
            for part in parts_of(text):
                held.append((i, words_of(part)))
                n[i] += len(held[-1][1])
                chars += len(part)
                if chars > 1 << 20:
                    self._add(held, total)
                    held, chars = [], 0
        self._add(held, total)
        langs, scores = [], []
        for own, k in zip(total, n, strict=True):
            if not k:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(own.argmax())
            langs.append(self.model.languages[best])
            # The root of the number of words keeps the score of long texts from being 1 always.
            scores.append(float(1.0 / np.exp((own - own[best]) / np.sqrt(k)).sum()))
        return langs, scores


def identify(text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value) if shared.value else None
        try:
            for texts in slices(batches):
                langs, scores = scorer.texts(list(texts)) if scorer else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pd.DataFrame({"lang_pred": langs, "score": scores})
        finally:
            del scorer
            release()

    return F.pandas_udf(run, "lang_pred string, score double")(text)


def reject_unknown(docs: DataFrame, model: Model | None, least: float = 0.0) -> DataFrame:
    """`docs` without those whose text has no letter or whose score is under `least`."""
    (into,) = fresh(docs, "_lang")
    bound_batches(docs.sparkSession)
    got = docs.withColumn(into, identify(F.col("text"), model))
    return got.where((F.col(f"{into}.lang_pred") != UNKNOWN) & (F.col(f"{into}.score") >= least)).drop(into)
