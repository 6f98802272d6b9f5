"""Repeated passages across a corpus, by FM-indexes of shards.

A window is `window` consecutive words. Every window whose words also start earlier (smaller id, or same document and
earlier start) is a repeat, and its words go. An index of the whole corpus fits no task, and streaming each document
through the index of each shard would grow with the square of the corpus. So text is dealt by content:

1. The anchor of a window is the smallest hash of its runs of `anchor` words; equal windows have equal anchors. Runs of
   windows with one anchor are a segment. Segments whose anchor occurs once hold no repeat and go no further.
2. Equal segments are counted by Spark (a minimum and a count for each, pre-aggregated), and one of each goes on.
3. Different segments of one anchor meet in a shard, dealt by anchor. It builds a compressed FM-index of them (a wavelet
   matrix and a sampled suffix array) in corpus order, and streams them through it: backward search gives the matching
   statistics of each word, and a window whose match reaches `window` words and begins earlier than itself is a repeat.
4. Later copies of a segment are looked up in an index of the first ones. Adjoining segments whose first copies adjoin in
   one document are one run of words; runs are dealt by that document, to shards whose indexes are written to a table,
   and each shard's later copies to as many tasks as their number asks for, each of which gets the shard's index. A run
   is streamed through it like any text: what matches from end to end, and begins earlier, is repeated as a whole;
   otherwise its windows are looked up one by one. In a task equal runs are streamed once. So a copy goes because its
   words are in an index, not because of its hash.
5. Where an anchor has more than `hot` different segments, they are cut into windows, counted by Spark like the segments
   in step 2. Repeated windows are segments of one window, and step 4 follows, so no shard grows with its copies.

Every removed word lies in a match that an index has reported; words are compared as 32 bits of their hashes, 20 in a row
at least. Shards hold about `shard` segments each, and tasks about `stream` copies of one run, at every size of the corpus.

Edge cases: a null or empty text has no words; rows without an id are left whole and repeat nothing; rows with the same
id and text count as one document, and of those with the same id and other texts the windows are taken as if the texts
stood side by side at the same places: what one of them repeats is taken out of all. Ties (equal windows) go to the
earlier start. Very long texts are one row of one task, hashed in parts. Columns n_words, n_removed and kept of the
input are replaced. Without repeats texts are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, cut, fresh, join_counted, slices, split_by, tidy
from .fm_index import FMIndex
from .words import BACK, GOLD, hash_texts, mix, powers, rolling, split_words


@dataclass(frozen=True)
class RepeatOptions:
    """window: words of a window. anchor: words of an anchor. hot: different segments of an anchor that stay together. shard: segments of a shard, about. stream: copies of one run that one task streams; documents whose runs have more have a shard of their own."""

    window: int = 20
    anchor: int = 6
    hot: int = 512
    shard: int = 6000
    stream: int = 1024


# A segment's start and number of windows in one long: start * PACK + windows.
PACK = 64


def least_of_next(v: np.ndarray, n: int) -> np.ndarray:
    """Where the least of each n values in a row is, the first of equals."""
    at, reach = np.arange(len(v)), 1
    while reach < n:
        step = min(reach, n - reach)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(v[b] < v[a], b, a)
        reach += step
    return at


def segments(h: np.ndarray, begin: np.ndarray, options: RepeatOptions) -> tuple[np.ndarray, ...]:
    """(text, anchor, hash of the words, first window, windows) of each segment of texts whose words' hashes are h[begin[i] : begin[i + 1]]."""
    n = len(h) - options.window + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    runs = rolling(h, options.anchor)
    where = least_of_next(runs, options.window - options.anchor + 1)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[:n]
    inside = np.arange(n) + options.window <= begin[text + 1]
    new = np.ones(n, bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    first, size = first[inside[first]], size[inside[first]]
    return text[first], runs[where[first]], hash_runs(h, first, first + size + options.window - 1), first - begin[text[first]], size


def hash_runs(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words h[first : end] of each run; it is the same wherever they stand."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * powers(GOLD, len(h))[:-1], dtype=np.uint64)])
    return mix((total[end] - total[first]) * powers(BACK, len(h))[first] + (end - first).astype(np.uint64))


def segment_rows(docs: DataFrame, options: RepeatOptions) -> DataFrame:
    """(id, anchor, seg, at): every segment of every document."""

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in slices(batches):
            h, begin = hash_texts(texts)
            text, anchor, seg, first, n = segments(h, begin, options)
            cuts = np.searchsorted(text, np.arange(1, len(texts)))
            yield pd.DataFrame({"anchor": np.split(anchor.view(np.int64), cuts), "seg": np.split(seg.view(np.int64), cuts), "at": np.split(first * PACK + n, cuts)})

    found = F.pandas_udf(run, "anchor array<long>, seg array<long>, at array<long>")
    return docs.where("id is not null").select("id", found("text").alias("s")).select("id", F.inline(F.arrays_zip("s.anchor", "s.seg", "s.at")))


SPANS = "id long, a long, b long"
# Places of the first copy's document at which runs end, so that every copy's runs end at the same words.
BLOCK = 256
# Copies of a run for each task, where runs of many documents share a shard.
FEW = 256


def _runs(unit: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive windows of one unit begin and end, of windows sorted by unit and place."""
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    return head, np.append(head[1:], len(unit))[: len(head)] - 1


def _windows(size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit, offset) of every window of units of `size` words."""
    n = np.maximum(size - window + 1, 0)
    unit = np.repeat(np.arange(len(size)), n)
    return unit, np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)


class Shard:
    """The index of a shard's segments, in corpus order, and where they stand in the corpus."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, units: list[np.ndarray]):
        self.ids, self.start, self.size = ids, start, np.array([len(u) for u in units])
        self.begin = np.cumsum(self.size + 1) - self.size - 1
        self.symbols = np.zeros(int((self.size + 1).sum()), np.int64)
        inside = np.ones(len(self.symbols), bool)
        inside[self.begin + self.size] = False
        self.words, code = np.unique(np.concatenate(units), return_inverse=True)
        self.symbols[inside] = code + 1
        self.index = FMIndex(self.symbols)

    def __getstate__(self) -> dict:
        # The index stands for the text.
        return {k: v for k, v in self.__dict__.items() if k not in ("symbols", "size")}

    def own_repeats(self, window: int, alone: np.ndarray) -> pd.DataFrame:
        """Runs (id, a, b) of windows that begin earlier in another segment; those of units that are `alone` meet none."""
        unit, offset = _windows(np.where(alone, 0, self.size), window)
        at = self.begin[unit] + offset
        length, low, high = self.index.matching(self.symbols, at + window, window, np.ones(len(at), bool))
        met = np.flatnonzero(length == window)
        met = met[self.index.earliest(low[met], high[met]) < at[met]]
        u, w = unit[met], self.start[unit[met]] + offset[met]
        head, tail = _runs(u, w)
        return pd.DataFrame({"id": self.ids[u[head]], "a": w[head], "b": w[tail]})

    def _place(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word) where the earliest suffix of each range begins."""
        at = self.index.earliest(low, high)
        unit = np.searchsorted(self.begin, at, side="right") - 1
        return self.ids[unit], self.start[unit] + at - self.begin[unit]

    def stream(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, begin, size) of runs of words as the index spells them; each after a 0, which a word that it hasn't got is too."""
        units = [np.frombuffer(w, np.uint32) for w in texts]
        size = np.array([len(u) for u in units])
        begin = np.cumsum(size + 1) - size
        symbols = np.zeros(int((size + 1).sum()), np.int64)
        inside = np.ones(len(symbols), bool)
        inside[begin - 1] = False
        words = np.concatenate(units)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        symbols[inside] = np.where(self.words[at] == words, at + 1, 0)
        return symbols, begin, size

    def repeats(self, ids: np.ndarray, start: np.ndarray, texts: list[bytes], window: int) -> pd.DataFrame:
        """Runs (id, a, b) of windows of streamed texts, which stand at word `start` of documents `ids`, that begin earlier in the index."""
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        symbols, begin, size = self.stream(list(number))
        length, low, high = self.index.matching(symbols, begin + size, int(size.max(initial=0)), np.zeros(len(size), bool))
        whole = length == size
        doc, word = np.full(len(size), np.iinfo(np.int64).max), np.zeros(len(size), np.int64)
        doc[whole], word[whole] = self._place(low[whole], high[whole])
        earlier = (doc[which] < ids) | ((doc[which] == ids) & (word[which] < start))
        sure = np.flatnonzero(earlier)
        found = [pd.DataFrame({"id": ids[sure], "a": start[sure], "b": start[sure] + size[which[sure]] - window})]
        left = np.flatnonzero(~earlier)
        if len(left):
            unit, offset = _windows(size[which[left]], window)
            row = left[unit]
            length, low, high = self.index.matching(symbols, begin[which[row]] + offset + window, window, np.zeros(len(row), bool))
            met = np.flatnonzero(length == window)
            doc, word = self._place(low[met], high[met])
            at = start[row[met]] + offset[met]
            ok = (doc < ids[row[met]]) | ((doc == ids[row[met]]) & (word < at))
            u, w = row[met][ok], at[ok]
            head, tail = _runs(u, w)
            found.append(pd.DataFrame({"id": ids[u[head]], "a": w[head], "b": w[tail]}))
        return pd.concat(found, ignore_index=True)


def _shard(pdf: pd.DataFrame) -> Shard:
    # Rows that share id and text are one.
    pdf = pdf.drop_duplicates(["id", "start", "words"]).sort_values(["id", "start"], kind="stable", ignore_index=True)
    return Shard(pdf["id"].to_numpy(), pdf["start"].to_numpy(), [np.frombuffer(w, np.uint32) for w in pdf["words"]])


def repeats_in_shard(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Runs (id, a, b) of windows of one shard's segments (id, start, words) that begin earlier in another of them."""
    own = _shard(pdf)
    return own.own_repeats(window, np.zeros(len(own.ids), bool))


def copies_in_shard(index: pd.DataFrame, copies: pd.DataFrame, window: int) -> pd.DataFrame:
    """Runs (id, a, b) of windows of copies (id, start, words) that the shard's index holds at an earlier place."""
    if not len(index) or not len(copies):
        return pd.DataFrame({"id": [], "a": [], "b": []}, dtype="int64")
    return pickle.loads(index["index"].iloc[0]).repeats(copies["id"].to_numpy(), copies["start"].to_numpy(), list(copies["words"]), window)


def _words_asked(batches: Iterator[pd.DataFrame], fields: tuple[str, ...], window: int) -> Iterator[tuple]:
    """Of frames (id, text, arrays of `fields`: at, seg, ...) what is asked of segments that the text has, by document and place: (fields, ids, rows, starts, windows, begin, hashes)."""
    for part, h, begin, row, asks in _asked_of(batches, fields):
        first, n = begin[row] + asks["at"] // PACK, asks["at"] % PACK
        end = first + n + window - 1
        # Another text with the same id may be shorter or have other words there.
        fits = end <= begin[row + 1]
        fits[fits] = hash_runs(h, first[fits], end[fits]).view(np.int64) == asks["seg"][fits]
        order = np.flatnonzero(fits)
        order = order[np.lexsort((first[order], row[order]))]
        yield {k: v[order] for k, v in asks.items()}, part["id"].to_numpy()[row[order]], row[order], asks["at"][order] // PACK, n[order], begin, (h >> np.uint64(32)).astype(np.uint32)


def _different(docs: DataFrame, asked: DataFrame, options: RepeatOptions, scratch: Scratch) -> DataFrame:
    """(id, a, b) of windows of the segments `asked` (id, anchor, seg, at) of docs (id, text) that repeat another segment's."""
    window, spark = options.window, docs.sparkSession
    shards = asked.count() // options.shard + 1
    with Scratch(spark) as early:
        fields = ("at", "seg", "shard")
        by_id = cut(asked.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("asked")), "asked", early)

        @tidy
        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for asks, ids, row, start, n, begin, short in _words_asked(batches, fields, window):
                a = begin[row] + start
                words = [short[x:y].tobytes() for x, y in zip(a.tolist(), (a + n + window - 1).tolist(), strict=True)]
                yield pd.DataFrame({"shard": asks["shard"], "id": ids, "start": start, "words": words})

        units = _with_fields(docs, by_id, fields).mapInPandas(fetch, "shard long, id long, start long, words binary")
        return cut(units.groupBy("shard").applyInPandas(lambda pdf: repeats_in_shard(pdf[["id", "start", "words"]], window), SPANS), "different", scratch)


def _copied(docs: DataFrame, rows: DataFrame, distinct: DataFrame, total: int, options: RepeatOptions, scratch: Scratch) -> DataFrame:
    """(id, a, b) of later copies, among `rows` (anchor, seg, id, at) of docs (id, text), of the segments `distinct` (anchor, seg, first, c), c over 1.

    total: number of rows.
    """
    window, stream, spark = options.window, options.stream, docs.sparkSession
    shards = distinct.count() // options.shard + 1
    with Scratch(spark) as units_only, Scratch(spark) as early:
        each = join_counted(rows, distinct, ["anchor", "seg"], total)
        fields = ("at", "seg", "c", "whose", "there")
        each = each.select("id", "at", "seg", "c", F.col("first.id").alias("whose"), F.col("first.at").alias("there"))
        by_id = cut(each.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("asked")), "asked", early)

        @tidy
        def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for asks, ids, row, start, n, begin, short in _words_asked(batches, fields, window):
                whose, there, c = asks["whose"], asks["there"] // PACK, asks["c"]
                hot, new = c > stream, np.ones(len(c), bool)
                same = [x[1:] == x[:-1] for x in (row, whose, there - start, there // BLOCK, hot)]
                new[1:] = ~np.logical_and.reduce(same) | (start[1:] != start[:-1] + n[:-1])
                head = np.flatnonzero(new)
                if not len(head):
                    continue
                many = np.add.reduceat(n, head)
                a = begin[row[head]] + start[head]
                words = [short[x:y].tobytes() for x, y in zip(a.tolist(), (a + many + window - 1).tolist(), strict=True)]
                lot = mix(ids[head].astype(np.uint64) * GOLD + start[head].astype(np.uint64))
                of = mix(whose[head].astype(np.uint64))
                parts = -(-np.maximum.reduceat(c, head) // np.where(hot[head], stream, FEW))
                leads = (whose[head] == ids[head]) & (there[head] == start[head])
                salt = np.where(leads, -1, (lot % parts.astype(np.uint64)).astype(np.int64))
                shard = np.where(hot[head], whose[head], (of % np.uint64(shards)).astype(np.int64))
                yield pd.DataFrame({"hot": hot[head], "shard": shard, "salt": salt, "id": ids[head], "start": start[head], "words": words})

        units = cut(_with_fields(docs, by_id, fields).mapInPandas(fetch, "hot boolean, shard long, salt long, id long, start long, words binary"), "units", units_only)
        leads = units.where("salt < 0").select("hot", "shard", "id", "start", "words")

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"hot": [key[0]], "shard": [key[1]], "index": [pickle.dumps(_shard(pdf))]})

        index = cut(leads.groupBy("hot", "shard").applyInPandas(build, "hot boolean, shard long, index binary"), "index", units_only)
        later = units.where("salt >= 0")
        wanted = index.join(later.select("hot", "shard", "salt").distinct(), ["hot", "shard"])
        wanted = wanted.select(F.col("hot").alias("h"), F.col("shard").alias("s"), F.col("salt").alias("t"), "index")
        found = wanted.groupBy("h", "s", "t").cogroup(later.groupBy("hot", "shard", "salt")).applyInPandas(lambda one, many: copies_in_shard(one, many, window), SPANS)
        return cut(found, "copied", scratch)


def _asked_of(batches: Iterator[pd.DataFrame], fields: tuple[str, ...]) -> Iterator[tuple]:
    """(rows, hashes of their words, where each text begins, row of each thing asked, arrays of its fields) of frames (id, text, arrays of `fields`)."""
    for pdf in batches:
        for texts in slices(iter([pdf["text"]])):
            part = pdf.loc[texts.index]
            h, begin = hash_texts(texts)
            many = [len(x) for x in part[fields[0]]]
            yield part, h, begin, np.repeat(np.arange(len(part)), many), {f: np.concatenate([np.asarray(x, np.int64) for x in part[f]]) for f in fields}


def _with_fields(docs: DataFrame, by_id: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, text, an array of each field) of the docs that are asked something; by_id: id and an array of structs."""
    both = split_by(docs, by_id, "id")[0].join(by_id, "id")
    return both.select("id", "text", *[F.col(f"asked.{f}").alias(f) for f in fields])


def repeated_windows(docs: DataFrame, options: RepeatOptions, scratch: Scratch) -> DataFrame:
    """(id, a, b): runs of repeated windows, by their first and last start, of docs (id, text)."""
    spark = docs.sparkSession
    with Scratch(spark) as tables:
        with Scratch(spark) as early:
            every = cut(segment_rows(docs, options), "segments", early)
            total = every.count()
            shared = cut(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1"), "anchors", early)
            rows = cut(join_counted(every, shared, ["anchor"], total).drop("c"), "shared", tables)
        distinct = cut(rows.groupBy("anchor", "seg").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("c")), "distinct", tables)
        kinds = cut(distinct.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "kinds", tables)
        hot = kinds.where(F.col("k") > options.hot).select("anchor")
        # Equal windows have one anchor, so only segments that share theirs with another one can repeat a part of it.
        met = distinct.join(kinds.where(F.col("k") <= options.hot).select("anchor"), "anchor").select("first.id", "anchor", "seg", "first.at")
        spans = _different(docs, met, options, scratch).union(_copied(docs, rows, distinct.where("c > 1"), total, options, scratch))
        if not hot.isEmpty():
            window = options.window

            @tidy
            def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part, h, begin, row, asks in _asked_of(batches, ("asked",)):
                    start, n = np.divmod(asks["asked"], PACK)
                    # A shorter text with the same id may end before.
                    n = np.maximum(np.minimum(n, np.diff(begin)[row] - window + 1 - start), 0)
                    place = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    row = np.repeat(row, n)
                    first = begin[row] + place
                    yield pd.DataFrame({"seg": hash_runs(h, first, first + window).view(np.int64), "id": part["id"].to_numpy()[row], "at": place * PACK + 1})

            wanted = cut(distinct.join(hot, "anchor").groupBy("first.id").agg(F.collect_list("first.at").alias("asked")), "hot", tables)
            texts = split_by(docs, wanted, "id")[0].join(wanted, "id").select("id", "text", "asked")
            windows = cut(texts.mapInPandas(windows_of, "seg long, id long, at long").select(F.col("seg").alias("anchor"), "seg", "id", "at"), "windows", tables)
            twice = windows.groupBy("anchor", "seg").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("c")).where("c > 1")
            spans = spans.union(_copied(docs, windows, cut(twice, "twice", tables), windows.count(), options, scratch))
        return spans


def keep_words(text: Column, repeats: Column, window: int) -> Column:
    """struct(n_words, n_removed, kept) of a text and its array of (a, b); kept is the words left, joined by spaces."""

    @tidy
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for t, spans in zip(texts, found, strict=True):
                words = split_words(t)
                n = len(words)
                if spans is not None and len(spans):
                    step = np.zeros(n + 1, np.int64)
                    for s in spans:
                        if s["b"] + window <= n:
                            step[s["a"]] += 1
                            step[s["b"] + window] -= 1
                    keep = np.cumsum(step[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                rows.append((n, n - len(words), b" ".join(words)))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return F.pandas_udf(run, "n_words long, n_removed long, kept binary")(text, repeats)


def _with_kept(docs: DataFrame, options: RepeatOptions, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """`docs` and a column, whose name is given, of struct(n_words, n_removed, kept)."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_windows(own, options, scratch).groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
        spans = cut(spans, "spans")
    key, found, into = fresh(docs, "_id", "_spans", "_kept")
    spans = spans.select(F.col("id").alias(key), F.col("spans").alias(found))
    maybe, whole = split_by(docs.withColumn(key, F.col(id_col).cast("long")), spans, key)
    joined = whole.withColumn(found, F.lit(None).cast(spans.schema[found].dataType)).unionByName(maybe.join(spans, key, "left"))
    return joined.withColumn(into, keep_words(F.col(text_col), F.col(found), options.window)).drop(key, found), into


def remove_repeats(docs: DataFrame, options: RepeatOptions = RepeatOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` and n_words, n_removed, kept (binary, UTF-8): the words that no repeated window covers."""
    out, into = _with_kept(docs, options, id_col, text_col)
    return out.withColumns({c: F.col(f"{into}.{c}") for c in ("n_words", "n_removed", "kept")}).drop(into)


def digests(docs: DataFrame, options: RepeatOptions = RepeatOptions()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    out = remove_repeats(docs.select("doc_id", "text"), options)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, options: RepeatOptions = RepeatOptions()) -> DataFrame:
    """`docs` with the repeated words out of their texts; a text without repeats stays as it is, and every row stays."""
    out, into = _with_kept(docs, options, "doc_id", "text")
    less = F.col(f"{into}.n_removed") > 0
    out = out.withColumn("text", F.when(less, F.col(f"{into}.kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(less, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


# The same result in SQL: the digest of every window. For small tables.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM words WHERE len(w) >= 20
), windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM starts
), numbered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM windows
), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM numbered WHERE n > 1
), gone AS (SELECT doc_id, list(j) AS js, count(*) AS n_removed FROM covered GROUP BY doc_id
), each_word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM words
), left_over AS (
  SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.j) AS kept FROM each_word e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.j = e.j WHERE c.j IS NULL GROUP BY e.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
