"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Leaves are paragraphs (lines); a long paragraph is cut into pieces after words whose hash says so, so that an edit
moves no cut but those beside it. The first `FINE` words of a text are leaves of their own, so that short texts have
several too. Sections are runs of leaves, closed after leaves whose hash says so. Each node has 128 bits: a leaf's are
the hash of its text, a section's that of its leaves' hashes, the root's that of the sections' hashes; so roots are equal
just if texts are (up to collisions of 128 bits). The fingerprint is the tree as text: the root, then each section with
its leaves, each leaf as the first 32 bits of its hash and its weight. Branches that differ locate edits.

Likeness of two fingerprints: 1 if the roots are equal; else the share of weight (code points) in leaves that both
have, by multiplicity, of the larger text's; under 1.

Edge cases: a null text is an empty one; two empty texts are alike (1). Rows with equal ids are ordered by a hash of
their text (equal texts are a tie that changes nothing); a null id comes last. In a table of one row the next document
is itself; an empty table gives no rows. A very long text is one row of one task. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, record_slices, slices

# Content-defined cuts: a piece ends after a word with this many low zero bits of its hash, a section after such a leaf.
PIECE_BITS, SECTION_BITS, PIECE_WORDS, SECTION_LEAVES, FINE = 2, 3, 16, 64, 16
WORD = re.compile(r"\s*\S+\s*?(?=\s|$)|\s+")

Leaf = tuple[str, int]  # the first 32 bits of its hash, and its weight in code points


class Ends(dict):
    """Whether a piece ends after a word; a bounded memory of one worker."""

    def __missing__(self, word: str) -> bool:
        end = not xxhash.xxh3_64_intdigest(word.strip().encode("utf-8", "surrogatepass")) & ((1 << PIECE_BITS) - 1)
        if len(self) < 300_000 and len(word) < 64:
            self[word] = end
        return end


_ENDS = Ends()


def leaves(text: str, fine: int = FINE) -> list[str]:
    """The text in pieces whose concatenation is the text: `fine` single words first. Where a piece ends, the next begins without memory."""
    out, ends = [], _ENDS
    for line in text.splitlines(keepends=True):
        held: list[str] = []
        for w in WORD.findall(line):
            if len(out) < fine:
                out.append(w)
                continue
            held.append(w)
            if ends[w] or len(held) >= PIECE_WORDS:
                out.append("".join(held))
                held = []
        if held:
            out.append("".join(held))
    return out


class Tree:
    """The tree of one text: leaves, sections of them, and the root."""

    def __init__(self, text: str, before: Tree | None = None, same: int = 0):
        """before: the tree of a text that has the first `same` code points too; its leaves there are taken over."""
        found: list[tuple[bytes, int]] = []
        at = 0
        if before:
            for leaf in before.found:
                # The last word before a change may go on in it.
                if at + leaf[1] >= same:
                    break
                found.append(leaf)
                at += leaf[1]
        digest = xxhash.xxh3_128_digest
        rest = leaves(text[at:] if at else text, max(0, FINE - len(found)))
        found += [(digest(x.encode("utf-8", "surrogatepass")), len(x)) for x in rest]
        self.size, self.found = len(text), found
        self.leaves: list[Leaf] = [(h[:4].hex(), n) for h, n in found]
        self.counts = Counter(self.leaves)
        self.sections: list[tuple[str, str]] = []
        tops, low, a = [], (1 << SECTION_BITS) - 1, 0
        for z, (h, _) in enumerate(found, 1):
            if not h[-1] & low or z - a >= SECTION_LEAVES or z == len(found):
                top = digest(b"".join([x for x, _ in found[a:z]]))
                tops.append(top)
                self.sections.append((top.hex(), ",".join([f"{x}:{n}" for x, n in self.leaves[a:z]])))
                a = z
        self.root = hashlib.blake2b(b"".join(tops), digest_size=16).hexdigest()

    def drawn(self) -> str:
        """root;section[leaf:weight,...]... with hashes in hex."""
        return ";".join([self.root, *(f"{top}[{body}]" for top, body in self.sections)])


def fingerprint(text: str | None) -> str:
    return Tree(text or "").drawn()


def parse(print_: str) -> tuple[str, list[tuple[str, list[tuple[str, int]]]]]:
    """(root, sections of (hash, leaves of (hash, weight)))."""
    root, *rest = print_.split(";")
    sections = []
    for s in rest:
        top, body = s[:-1].split("[", 1)
        sections.append((top, [(h, int(n)) for h, n in (x.split(":") for x in body.split(","))]))
    return root, sections


def _shared(x: Counter, y: Counter, most: int) -> float:
    """The weight of leaves that both have; under 1, since the roots differ."""
    if len(x) > len(y):
        x, y = y, x
    both = sum(n * min(k, y[h, n]) for (h, n), k in x.items() if (h, n) in y)
    return min(both / most, 0.999999) if most else 0.0


def likeness(x: str, y: str) -> float:
    """0 to 1, of two fingerprints."""
    (rx, sx), (ry, sy) = parse(x), parse(y)
    if rx == ry:
        return 1.0
    cx, cy = (Counter(leaf for _, own in s for leaf in own) for s in (sx, sy))
    return _shared(cx, cy, max(sum(n * k for (_, n), k in c.items()) for c in (cx, cy)))


def alike(x: Tree, y: Tree) -> float:
    """The likeness of two trees' fingerprints, without drawing them."""
    return 1.0 if x.root == y.root else _shared(x.counts, y.counts, max(x.size, y.size))


def differing(x: str, y: str) -> list[tuple[int, int]]:
    """Code point ranges of x whose leaves y hasn't got: where x was edited."""
    (rx, sx), (ry, sy) = parse(x), parse(y)
    if rx == ry:
        return []
    tops, left = {t for t, _ in sy}, Counter(leaf for _, s in sy for leaf in s)
    out, at = [], 0
    for top, own in sx:
        for leaf in own:
            if top not in tops and not left[leaf]:
                if out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + leaf[1])
                else:
                    out.append((at, at + leaf[1]))
            at += leaf[1]
    return out


def fingerprints(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            yield pd.Series([fingerprint(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def edited(text: str, after: str) -> str:
    """`text` with its last third replaced by the beginning of `after`."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """`docs` (doc_id, text) dealt into ranges of descending id, each with the first row of the range after it (`extra`), so that a task sees each of its rows beside the next one.

    Bounds come from quantiles of the ids, the extra rows from each range's largest id; text is shuffled once.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    bounds = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    edges = np.array(bounds, np.int64)

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for many in batches:
            yield pd.Series(len(edges) - np.searchsorted(edges, many.to_numpy(), side="right"), dtype="int32")

    # Range 0 has the largest ids. A null id is in the last range.
    number = F.pandas_udf(place, "int")(F.coalesce("doc_id", F.lit(0)).cast("long"))
    ranged = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(number)
    heads = ids.withColumn("r", ranged).groupBy("r").agg(F.max("doc_id").alias("head"), F.count("*").alias("c")).orderBy("r").collect()
    if not heads:
        return docs.withColumn("r", F.lit(0)).withColumn("extra", F.lit(False))
    # The first row of each range closes the range before; that of the first closes the last.
    to = {heads[(i + 1) % len(heads)]["r"]: heads[i]["r"] for i in range(len(heads))}
    head = {h["r"]: h["head"] for h in heads}
    table = spark.createDataFrame([(r, head[r], to[r]) for r in to], "r int, head long, goes int")
    extra = docs.withColumn("r", ranged).join(F.broadcast(table), "r").where(F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("goes").alias("r"), F.lit(True).alias("extra"))
    both = docs.select("doc_id", "text", ranged.alias("r"), F.lit(False).alias("extra")).union(extra)
    return both.repartitionById(len(bounds) + 1, "r").sortWithinPartitions("r", "extra", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def digests(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = with_next(own, ranges or partitions(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: range, id, text, tree
        for batch in record_slices(batches):
            rows = []
            for doc, text, r, extra in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "r", "extra")), strict=True):
                own = Tree(text)
                if held and held[0] == r:
                    rows.append(_row(held[1], held[2], held[3], text, own))
                # Of extra rows only the first closes its range.
                held = None if extra else (r, doc, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(TYPES)], names=NAMES)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(doc: int | None, text: str, own: Tree, after: str, after_tree: Tree) -> tuple:
    changed = edited(text, after)
    tree = own if changed == text else Tree(changed, own, len(text) - len(text) // 3)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.drawn(), tree.drawn(), alike(own, tree), alike(own, after_tree)
