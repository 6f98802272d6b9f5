"""Secret scan: fixed patterns, and strings that a tokenizer's vocabulary compresses badly.

Ordinary words are covered by long vocabulary entries, so they have many characters per token; random strings fall
apart into short ones. A run of key characters with a low ratio is reported, unless it is a digest or an identifier
of a known form or lies on a span that a pattern reported. Camel case and separated words are identifiers only where
the vocabulary covers the words themselves: only the joints may cost tokens.

Edge cases: a null or empty text has no spans. Offsets are code points, ends exclusive. Repeated rows each give a row;
an empty table gives none. Spans that begin together are a tie, in the order in which kinds are listed. A very long text
is one row of one task. Other columns are left out by `scan_secrets` and kept by `redact`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, tidy, vocabulary

# The base kinds in their order of listing, and their patterns.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

# Lengths in hex digits of well-known digests, and forms of identifiers.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PARTED = (
    re.compile(r"[A-Z]?[a-z]+([A-Z][a-z]+)+[0-9]{0,3}"),  # camel case
    re.compile(r"([A-Za-z]+|[0-9]+)([_/=-]+([A-Za-z]+|[0-9]+))*"),  # words or numbers joined by separators
)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass(frozen=True)
class ScanOptions:
    """min_chars: shortest run that is judged. max_ratio: characters per token at or under which it is reported."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    min_chars: int = 20
    max_ratio: float = 2.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by start, then kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def known_form(s: str) -> bool:
    """A digest or a UUID, which is no secret however random it looks."""
    if len(s) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return True
    return bool(UUID.fullmatch(s))


class Scanner:
    """Holds the vocabulary of one Python worker."""

    def __init__(self, options: ScanOptions, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        import public_tokenizers

        self.options = options
        self.encoding = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.run = re.compile(rf"[A-Za-z0-9+/_=-]{{{options.min_chars},}}")

    def badly_compressed(self, parts: list[str]) -> bool:
        return sum(map(len, parts)) <= self.options.max_ratio * sum(len(self.encoding.encode_ordinary(p)) for p in parts)

    def identifier(self, s: str) -> bool:
        """Camel case or words joined by separators, of parts that the vocabulary covers well; capitals alone count as small letters."""
        return any(p.fullmatch(s) for p in PARTED) and not self.badly_compressed([p.lower() if p.isupper() else p for p in PART.findall(s)])

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, base spans and those of the token ratio)."""
        base = base_spans(text)
        more, at, reach = [], 0, 0
        for m in self.run.finditer(text):
            # Both run through the text: reach is the last end of the base spans that begin before this run ends.
            while at < len(base) and base[at][1] < m.end():
                reach = max(reach, base[at][2])
                at += 1
            s = m[0]
            if reach > m.start() or known_form(s):
                continue
            if self.badly_compressed([s]) and not self.identifier(s):
                more.append(("token", *m.span()))
        return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def scan_secrets(docs: DataFrame, options: ScanOptions = ScanOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: counts by kind, digest of the base spans, and all spans."""
    path = vocabulary(options.vocabulary)

    @tidy
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(options, path)
        for texts in slices(batches):
            rows = []
            for text in texts:
                base, spans = scanner.spans(text or "")
                kinds = [k for k, _, _ in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    found = F.pandas_udf(scan, FOUND)(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("found")).select("doc_id", "found.*")


def redact(docs: DataFrame, options: ScanOptions = ScanOptions(), mask: str = "<secret>") -> DataFrame:
    """`docs` with every reported span replaced by `mask`; other columns are kept, and no document goes.

    Overlapping spans are replaced together. A null text stays null. `n_chars`, where there is one, follows the text.
    """
    bound_batches(docs.sparkSession)
    path = vocabulary(options.vocabulary)

    @tidy
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(options, path)

        def one(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for _, a, b in scanner.spans(text)[1]:
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join([*out, text[at:]]) if out else text

        for texts in slices(batches):
            yield pd.Series([one(x) for x in texts], dtype=object)

    out = docs.withColumn("text", F.pandas_udf(clean, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
