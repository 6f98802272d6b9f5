"""How much of a source survives in an output, and the gate over it."""

from __future__ import annotations

import builtins
import keyword
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes at which the character ratio is bounded or left out, and lines of a copied span.
EXACT_CHARS, BOUND_CHARS, SPAN_LINES = 30_000, 200_000, 5
# The identifiers that tell whose a text is, and names of languages and their libraries, which tell nothing,
# besides the keywords and built-in names of Python.
CONTENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,}")
LIBRARY = """
self cls args kwargs annotations __future__ __init__ __str__ __repr__ __name__ __main__ dataclass dataclasses field datetime
timedelta timezone sqlite3 json pathlib Path typing Optional Iterable Sequence Iterator Callable argparse logging Logger
collections defaultdict namedtuple itertools functools contextlib hashlib sha256 time math random textwrap unicodedata
requests append extend strip rstrip lstrip split splitlines join format encode decode lower upper startswith endswith
replace keys values items fetchone fetchall execute executemany cursor conn commit close read read_text write write_text
utf-8 isoformat utcnow SELECT FROM WHERE ORDER LIMIT DESC ASC INSERT INTO VALUES UPDATE GROUP NULL AND NOT LEFT JOIN CREATE
TABLE EXISTS INTEGER TEXT PRIMARY
""".split()
NO_CONTENT = frozenset(LIBRARY) | frozenset(keyword.kwlist) | frozenset(dir(builtins))


# Suffixes of languages with // and /* */ comments.
C_LIKE = frozenset((".go", ".ts", ".tsx", ".js", ".java", ".c", ".cc", ".cpp", ".rs"))
# A comment that opens a line, with the rest of the line that it ends on; a triple-quoted block likewise, if it has several lines.
BLOCK = re.compile(r"^[ \t]*/\*(?:(?!\*/)[^\n])*+(?:\n(?:(?!\*/)[^\n])*+)*+(?:\*/[^\n]*)?", re.M)
DOCSTRING = re.compile(r'(?P<q>"""|\'\'\')(?:(?!(?P=q))[^\n])*+(?:(?P=q)|(?P<more>\n(?:(?!(?P=q))(?:.|\n))*+(?:(?P=q)[^\n]*)?)|$)')


def code_lines(text: str, suffix: str = ".go") -> list[str]:
    """Stripped lines without blank lines, comments and docstrings.

    What follows a comment mark within a line goes too, but not on a line with a quote, as it may lie in a string.
    """
    if suffix in C_LIKE:
        opens, mark, quotes, text = ("//", "*", "/*"), "//", "\"`", BLOCK.sub("", text)
    else:
        opens, mark, quotes = ("#",), "#", "\"'"
        text = DOCSTRING.sub("", "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("#")))
    lines = (x.strip() for x in text.splitlines())
    kept = (x if any(q in x for q in quotes) else x.split(mark, 1)[0].strip() for x in lines if not x.startswith(opens))
    return [x for x in kept if x]


def content(lines: Iterable[str]) -> set[str]:
    """Identifiers of code lines that an honest rewriting replaces."""
    return {w for line in lines for w in CONTENT.findall(line)} - NO_CONTENT


def inspect(source: str, output: str, suffix: str = ".go", floor: float = 0.95) -> dict:
    """The report of one pair.

    ratio is null where it would take long and its bound is under `floor`, and for very long texts, as is their bound.
    """
    a, b = code_lines(source, suffix), code_lines(output, suffix)
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    spans = [m.size for m in blocks if m.size >= SPAN_LINES]
    run = max((m.size for m in blocks), default=0)
    own, words, lines = content(a), content(b), set(a)
    lines_kept = sum(1 for x in b if x in lines) / len(b) if b else 1.0
    size, ratio, bound = len(source) + len(output), None, None
    if size <= BOUND_CHARS:
        m = SequenceMatcher(None, source, output)
        bound = round(m.quick_ratio(), 3)
        ratio = round(m.ratio(), 3) if size <= EXACT_CHARS or m.quick_ratio() >= floor else None
    return {
        "src_lines": len(a), "out_lines": len(b), "ratio": ratio, "ratio_bound": bound, "retention": round(len(own & words) / len(own), 3) if own else 0.0, "verbatim": round(lines_kept, 3),
        "longest_run": run, "run_share": round(run / len(a), 3) if a else 0.0, "copied_spans": len(spans), "copied_share": round(sum(spans) / len(a), 3) if a else 0.0,
    }


REPORT = "src_lines long, out_lines long, ratio double, ratio_bound double, retention double, verbatim double, longest_run long, run_share double, copied_spans long, copied_share double"


def report(source: Column, output: Column) -> Column:
    """struct of `inspect` for two text columns; nulls count as empty."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for xs, ys in batches:
            yield pd.DataFrame([inspect(x or "", y or "") for x, y in zip(xs, ys, strict=True)], columns=[c.split()[0] for c in REPORT.split(", ")])

    return F.pandas_udf(run, REPORT)(source, output)


def leak_pattern(terms: Iterable[str]) -> re.Pattern:
    """Whole words or phrases regardless of case, the longest first; no terms match nothing."""
    return re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(set(terms), key=lambda t: (-len(t), t))))})\b" if terms else r"(?!)", re.I)


def score(source: str, output: str, suffix: str, pattern: re.Pattern) -> dict:
    """How much of a source file an output keeps: lines, vocabulary, copied spans, shape and leak terms.

    leak_terms: on how many lines each term is; shape_loss: how many fewer lines of each kind the output has, where they
    differ; passthrough: whether the output is its source but for little.
    """
    from .code import SHAPE

    r = inspect(source, output, suffix)
    a, b = code_lines(source, suffix), code_lines(output, suffix)
    own, all_lines = set(a), {x.strip() for x in source.splitlines()}
    long = [x for x in b if len(x) >= 8]
    leaks = [(line, {m[0].lower() for m in pattern.finditer(line)}) for line in map(str.strip, output.splitlines())]
    leaks = [(line, found) for line, found in leaks if found]
    kept = set().union(*(found for _, found in leaks)) if leaks else set()
    terms = {m[0].lower() for m in pattern.finditer(source)}
    count = lambda lines: [sum(1 for x in lines if re.match(p, x)) for p in SHAPE.values()]
    before, after = count(a), count(b)
    by_term = Counter(t for _, found in leaks for t in found)
    return {
        **r, "verbatim_long": round(sum(x in own for x in long) / len(long), 3) if long else 1.0, "shape_fidelity": round(1 - sum(abs(x - y) for x, y in zip(before, after, strict=True)) / sum(before), 3) if sum(before) else 1.0,
        "leak_lines": len(leaks), "leak_lines_verbatim": sum(line in all_lines for line, _ in leaks), "domain_terms": len(terms), "domain_retention": round(len(terms & kept) / len(terms), 3) if terms else 0.0,
        "leak_terms": dict(by_term), "shape_loss": {k: x - y for k, x, y in zip(SHAPE, before, after, strict=True) if x != y}, "passthrough": r["retention"] >= 0.92 and (r["ratio"] or 0.0) >= 0.95,
    }


SCORE = "verbatim_long double, shape_fidelity double, leak_lines long, leak_lines_verbatim long, domain_terms long, domain_retention double, leak_terms map<string,bigint>, shape_loss map<string,bigint>, passthrough boolean"


def scores(source: Column, output: Column, terms: Iterable[str], suffix: str = ".go") -> Column:
    """struct of `score` for two text columns; nulls count as empty. terms: a short list, as it travels with the function."""
    pattern, kind = leak_pattern(list(terms)), f"{REPORT}, {SCORE}"

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for xs, ys in batches:
            yield pd.DataFrame([score(x or "", y or "", suffix, pattern) for x, y in zip(xs, ys, strict=True)], columns=[c.split()[0] for c in kind.split(", ")])

    return F.pandas_udf(run, kind)(source, output)


@dataclass(frozen=True)
class Thresholds:
    """The gate's thresholds. They are parameters of a call, not of the environment."""

    least_lines: int = 12
    run_lines: int = 20
    run_share: float = 0.15
    copied_share: float = 0.35
    retention: float = 0.92
    ratio: float = 0.95
    verbatim: float = 0.95


def gate(r: Column, leaked: Column, t: Thresholds = Thresholds()) -> Column:
    """The verdict over a report: a leaked module name counts before the size does."""
    near = (F.coalesce(r["ratio"], F.lit(0.0)) >= t.ratio) | (r["verbatim"] >= t.verbatim)
    return (
        F.when(leaked, "refused: module name")
        .when(r["src_lines"] < t.least_lines, "too small")
        .when((r["longest_run"] >= t.run_lines) | (r["run_share"] >= t.run_share), "refused: run")
        .when(r["copied_share"] >= t.copied_share, "refused: copied")
        .when((r["retention"] >= t.retention) & near, "refused: echo")
        .otherwise("passed")
    )


def leaked(source: Column, output: Column) -> Column:
    """Whether an output has the name of a module that its source imports from itself, as a whole word regardless of case."""
    from .code import own_modules

    return F.exists(own_modules(source), lambda n: F.regexp_like(output, F.concat(F.lit(r"(?iU)\b\Q"), n, F.lit(r"\E\b"))))
