"""Code-shaped texts: counters, module names, targets, fences and replies, as column expressions."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the structural counters, by family of languages.
COUNTERS = {
    "go": {"funcs": r"(?m)^\s*func\s", "structs": r"\btype\s+\w+\s+struct\b", "interfaces": r"\btype\s+\w+\s+interface\b"},
    "ts": {"funcs": r"\b(?:function\s+\w+|=>\s*\{|\w+\s*\([^)]*\)\s*\{)", "structs": r"\bclass\s+\w+", "interfaces": r"\b(?:interface|type)\s+\w+\s*[={]"},
}
IMPORTS = r"""(?m)^\s*(?:import\b|from\s+['"]|\w+\s+"[^"]+"\s*$)"""
EXPORTS = r"(?m)^\s*export\s+"
STRINGS = r"""`(?:[^`\\]|\\.)*`|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
# Kinds of code lines whose census is a text's shape.
SHAPE = {
    "def": r"^\s*(?:async\s+)?def\s|^\s*func\s",
    "class": r"^\s*(?:class|type)\s",
    "branch": r"^\s*(?:if|elif|else|switch|case)\b",
    "loop": r"^\s*(?:for|while)\b",
    "except": r"^\s*(?:try|except|catch|finally|rescue)\b",
    "return": r"^\s*(?:return|yield)\b",
}
# Roots of the standard library's import paths, and names too general to tell whose a module is.
STANDARD = "archive bufio builtin bytes cmp compress container context crypto database debug embed encoding errors expvar flag fmt go hash html image index io iter log maps math mime net os path plugin reflect regexp runtime slices sort strconv strings structs sync syscall testing text time unicode unsafe weak".split()
GENERAL = "app api src lib pkg internal cmd main core common util utils shared server client service handler model store data test tests build dist vendor project backend frontend web http json".split()
IMPORT_LINE = r'(?m)^\s*(?:_\s+|\.\s+|[A-Za-z_]\w*\s+)?"([^"]+)"\s*$'
# What the profile of a text counts besides the counters, and the words of its template.
HANDLERS = {"go": r"func\s*\([^)]*\)\s*\w+\s*\(\s*\w+\s+http\.ResponseWriter\s*,", "ts": r"(?m)^\s*export\s+function\s+[A-Z]\w*\s*\("}
GO_BLOCK, GO_SINGLE, GO_LINE = r"(?ms)^import\s*\(([^)]*)\)", r'(?m)^import\s+(?:\w+\s+)?["`]', r'(?m)^\s*(?:[\w.]+\s+)?["`][^"`]+["`]\s*$'
GO_EXPORTED = r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)|type\s+([A-Z]\w*)|(?:var|const)\s+([A-Z]\w*))"
TEMPLATE = "structural profile language lines bytes functions handlers components structs classes interfaces types imports exports string literals max brace depth go ts tsx".split()


COUNTER_NAMES = ("lines", "bytes", "funcs", "structs", "interfaces", "imports", "exports", "string_literals", "max_brace_depth")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_count(text: Column) -> Column:
    """Line ends, and one more if the text goes on after the last."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def brace_depth(text: Column) -> Column:
    """The deepest nesting of braces; a surplus closing brace doesn't count."""
    braces = F.regexp_extract_all(text, F.lit("[{}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("best"))

    def step(a: Column, b: Column) -> Column:
        d = F.when(b == "{", a["d"] + 1).otherwise(F.greatest(F.lit(0), a["d"] - 1))
        return F.struct(d.alias("d"), F.greatest(a["best"], d).alias("best"))

    return F.aggregate(braces, start, step)["best"].cast("long")


def counters(text: Column, family: str) -> list[Column]:
    """The nine structural counters. Strings are matched possessively, so long ones take no stack."""
    own = [matches(text, p).alias(name) for name, p in COUNTERS[family].items()]
    # In the order of COUNTER_NAMES.
    return [line_count(text).alias("lines"), F.octet_length(text).cast("long").alias("bytes"), *own, matches(text, IMPORTS).alias("imports"), matches(text, EXPORTS).alias("exports"), matches(text, STRINGS.replace(")*", ")*+")).alias("string_literals"), brace_depth(text).alias("max_brace_depth")]


def code_lines(text: Column) -> Column:
    """Stripped lines of a C-like text without blank lines and comments.

    A comment that opens a line goes with its lines, the one that it ends on included. What follows `//` goes too, but not
    on a line with a quote or a backtick, as it may lie in a string.
    """
    bare = F.regexp_replace(text, r"(?m)^[ \t]*/\*(?:(?!\*/)[^\n])*+(?:\n(?:(?!\*/)[^\n])*+)*+(?:\*/[^\n]*)?", "")
    lines = F.transform(F.split(bare, r"\r\n|[\n\r]"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: ~x.rlike(r"^(//|\*|/\*)"))
    cut = F.transform(kept, lambda x: F.when(x.rlike('["`]'), x).otherwise(F.rtrim(F.split_part(x, F.lit("//"), F.lit(1)))))
    return F.filter(cut, lambda x: x != "")


def _lines_like(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")


def shape(lines: Column) -> list[Column]:
    """How many code lines (an array) are of each kind."""
    return [_lines_like(lines, p).alias(name) for name, p in SHAPE.items()]


def shape_fidelity(before: Column, after: Column) -> Column:
    """1 less the share of differences in the counts by kind of two arrays of code lines; 1 without any."""
    pairs = [(_lines_like(before, p), _lines_like(after, p)) for p in SHAPE.values()]
    total = sum((b for b, _ in pairs), F.lit(0))
    return F.when(total == 0, 1.0).otherwise(1 - sum((F.abs(b - a) for b, a in pairs), F.lit(0)) / total)


def own_modules(text: Column) -> Column:
    """Sorted names of the modules that a Go text imports from itself.

    A first segment that belongs to the standard library, is general or short tells nothing. Of a path with a host only
    the one or two segments before `internal` count, which only its own module may import.
    """
    tells = lambda s: ~s.contains(".") & (F.length(s) >= 4) & ~F.lower(s).isin(*GENERAL)

    def names(path: Column) -> Column:
        segments = F.split(path, "/")
        first = segments[0]
        inner = F.array_position(F.slice(segments, F.lit(2), F.size(segments)), "internal").cast("int")
        hosted = F.when(inner > 0, F.filter(F.slice(segments, F.lit(2), F.least(F.lit(2), inner - 1)), tells))
        plain = F.when(tells(first), F.array(first))
        return F.coalesce(F.when(first.isin(*STANDARD), None).when(first.contains("."), hosted).otherwise(plain), F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(IMPORT_LINE), F.lit(1)), names))))


def profile(text: Column, language: str) -> Column:
    """The profile of a text as a template of words and numbers; language: go, ts or tsx."""
    go = language == "go"
    family = "go" if go else "ts"
    counted = dict(zip(COUNTER_NAMES, counters(text, family), strict=True))
    blocks = F.regexp_extract_all(text, F.lit(GO_BLOCK), F.lit(1))
    imports = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + matches(b, GO_LINE)) + matches(text, GO_SINGLE) if go else counted["imports"]
    exports = matches(text, GO_EXPORTED) if go else counted["exports"]
    rows = [
        ("language", F.lit(language)), ("lines", counted["lines"]), ("bytes", counted["bytes"]), ("functions", counted["funcs"]), ("handlers" if go else "components", matches(text, HANDLERS[family])),
        ("structs" if go else "classes", counted["structs"]), ("interfaces" if go else "types", counted["interfaces"]), ("imports", imports), ("exports", exports), ("string literals", counted["string_literals"]), ("max brace depth", counted["max_brace_depth"]),
    ]
    return F.concat(F.lit("STRUCTURAL PROFILE\n"), *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\n")) for name, value in rows])


def foreign_words(stub: Column) -> Column:
    """Words of a profile that its template hasn't got: none, or it tells something of its source."""
    words = F.regexp_extract_all(stub, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~F.lower(w).isin(*TEMPLATE)))


SPACES = " \t\n\r\f\x0b"
# A line that opens or closes a fenced block, one that can only close it, and marks of code in a line.
FENCE, BARE_FENCE, CODE_MARKS = r"^```[^`]*$", r"^```\s*$", "[{};=]"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{SPACES}]+|[{SPACES}]+\z", "")


def _rstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"[{SPACES}]+\z", "")


def _without_close(x: Column) -> Column:
    return F.when(x.endswith("```"), F.substr(x, F.lit(1), F.length(x) - 3)).otherwise(x)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unfenced(text: Column) -> Column:
    """A text without the fence that wraps the whole of it; other texts without the white space around them."""

    def unwrap(s: Column) -> Column:
        end = F.locate("\n", s)
        return F.when(~s.startswith("```") | (end == 0), s).otherwise(_rstrip(_without_close(F.substr(s, end + 1))))

    return _let(_strip(text), unwrap)


def fenced(text: Column, source: Column | None = None) -> Column:
    """struct(body, discarded, error) of a reply.

    body is what its one fenced block wraps, discarded the number of characters on the lines around it. Up to three lines
    of prose may come before the block: three words or more, a stop at the end, no mark of code. A reply without fences,
    one that is wholly a block, or one to a source with fences of its own is unwrapped as it is. Whatever else has fences
    is refused: error says so and the body is null. A null reply gives nulls.
    """
    is_fence = lambda x: _rstrip(x).rlike(FENCE)
    prose = lambda x: (F.size(F.filter(F.split(_strip(x), r"\s+"), lambda w: w != "")) >= 3) & _strip(x).rlike(r"[:.!]\z") & ~x.rlike(CODE_MARKS)
    own = F.lit(False) if source is None else F.exists(F.split(F.coalesce(source, F.lit("")), r"\r\n|[\n\r]"), is_fence)

    def read(r: Column) -> Column:
        lines, at, n = r["lines"], r["at"], F.size(r["at"])
        first, second = F.get(at, F.lit(0)), F.get(at, F.lit(1))
        kept = (n == 0) | r["own"] | ((first == 1) & ((n == 1) | (second == F.size(lines))))
        before = F.filter(F.slice(lines, 1, F.greatest(first - 1, F.lit(0))), lambda x: _strip(x) != "")
        unsure = (n > 2) | (F.size(before) > 3) | F.exists(before, lambda x: ~prose(x)) | ((n == 2) & ~_rstrip(F.element_at(lines, second)).rlike(BARE_FENCE))
        return _let(F.struct(lines.alias("lines"), n.alias("n"), first.alias("first"), F.when(n == 2, second).otherwise(F.size(lines) + 1).alias("close"), kept.alias("kept"), (~kept & unsure).alias("refused")), cut)

    def cut(r: Column) -> Column:
        lines, first, close = r["lines"], r["first"], r["close"]
        body = F.array_join(F.slice(lines, first + 1, F.greatest(close - first - 1, F.lit(0))), "\n")
        body = _rstrip(F.when(r["n"] == 1, _without_close(body)).otherwise(body))
        around = F.transform(lines, lambda x, i: F.when((i + 1 < first) | (i + 1 > close), F.length(x)).otherwise(0))
        return F.struct(
            F.when(r["kept"], unfenced(F.array_join(lines, "\n"))).when(~r["refused"], body).alias("body"),
            F.when(r["kept"], F.lit(0).cast("long")).when(~r["refused"], F.aggregate(around, F.lit(0).cast("long"), lambda a, k: a + k)).alias("discarded"),
            F.when(r["refused"], "text outside a single fenced block").alias("error"),
        )

    fences = lambda lines: F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: is_fence(F.element_at(lines, i)))
    return F.when(text.isNotNull(), _let(F.split(_strip(text), "\n"), lambda lines: _let(F.struct(lines.alias("lines"), fences(lines).alias("at"), own.alias("own")), read)))


# Targets of a translation, by id and what they are about.
TARGETS = {
    "graph-traversal": "abstract graph traversal over labelled nodes",
    "tensor-pipeline": "a pure computation pipeline over numeric tensors",
    "event-scheduler": "a generic event-loop scheduler over opaque tasks",
    "chess-engine": "a chess engine with positions, moves, and evaluations",
    "recipe-manager": "a recipe-management app with ingredients, steps, and meal plans",
    "wildlife-tracker": "a wildlife tracking system with species, sightings, and migration routes",
    "logistics-dispatch": "a logistics dispatch system with shipments, routes, and carriers",
    "music-streaming": "a music streaming service with tracks, playlists, and listeners",
    "hotel-booking": "a hotel booking platform with rooms, reservations, and guests",
}


def pick_target(text: str | None, free: str | None, chosen: str | None) -> tuple[str, str | None]:
    """(what a text is translated to, its id): a free description first, then a chosen id, then by the text's hash. An unknown id is an error."""
    if free and free.strip():
        return free.strip(), None
    if chosen and chosen.strip():
        if chosen.strip() not in TARGETS:
            raise ValueError(f"unknown target: {chosen}")
        return TARGETS[chosen.strip()], chosen.strip()
    name = list(TARGETS)[int.from_bytes(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()[:8], "big") % len(TARGETS)]
    return TARGETS[name], name


def target(text: Column, n: int = 9) -> Column:
    """A choice of n by the first 8 bytes of the text's sha256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n


def blob_id(text: Column) -> Column:
    """The object id that a version-control blob of the text has."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string"), F.lit("\0")), "UTF-8"), F.encode(text, "UTF-8")))


# The clause that every Go text has, marks of TypeScript, and how much of a text is looked at for marks.
GO_CLAUSE, TS_MARKS, HEAD = r"(?m)^package\s+[A-Za-z_]\w*\s*(?://.*)?$", ("=> ", "const ", "interface ", "export ", "function "), 4000


def suffix(text: Column) -> Column:
    """A file suffix from the look of a text's head."""
    head = F.substring(text, 1, HEAD)
    go = (head.contains("package ") & head.contains("func ")) | head.rlike(GO_CLAUSE)
    ts = functools.reduce(lambda a, b: a | b, [head.contains(m) for m in TS_MARKS]) & ~head.contains("def ")
    return F.when(go, ".go").when(ts, ".ts").otherwise(".py")


def dotted_suffix(value: Column) -> Column:
    """A suffix as given ("ts", ".TS", " go ") in lower case with its dot; null for blanks, so that it is found by the text's look."""
    s = F.lower(_strip(value))
    return F.when(s == "", None).when(s.startswith("."), s).otherwise(F.concat(F.lit("."), s))


def reply(text: Column, schema: str) -> Column:
    """The object from the first { to the last } of a reply; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
