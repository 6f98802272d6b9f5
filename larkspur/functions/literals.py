"""Classes, sub-classes, skeletons and placeholders of string literals, as column expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .batches import in_parts

# The patterns of the classes, which are tried in this order on the stripped content. PATH has \p{L}\p{N}_
# for \w, since letters and digits of all scripts count there.
URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s]+$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
KEY_PREFIX = r"^(?:sk_|pk_|ghp_|ghs_|AKIA|ASIA|xox[abp]-|AIza)[A-Za-z0-9_\-]{8,}$"
SQL = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|CREATE\s+TABLE)\b"
MIME = r"(?i)^(?:application|audio|font|image|message|model|multipart|text|video)/(?:(?:vnd|prs|x)\.[A-Za-z0-9.+\-]+|[A-Za-z0-9+\-]+)(?:\s*;.*)?$"
SHORTHAND = r"(?i)^(?:\d+(?:/\d+)+|and/or|n/a|km/h|mi/h|yes/no|on/off|true/false|w/o|he/she)$"
PATH = r"^(?:/|\./|\.\./|~/|[A-Za-z]:[\\/]|[A-Za-z0-9_.\-]+/)[\p{L}\p{N}_./\\\-]*$"
KEY = r"^[A-Za-z0-9+/=_\-]{32,}$"
# Quotes and what may stand between them, tried in this order; and the content of a single character.
QUOTES = (
    ('"""', r'"""(?:\\.|[^\\])*?"""'),
    ("'''", r"'''(?:\\.|[^\\])*?'''"),
    ('"', r'"(?:\\.|[^"\\])*"'),
    ("'", r"'(?:\\.|[^'\\\n])*'"),
    ("`", r"`(?:\\.|[^`\\])*`"),
)
RUNE = r"""[^\\'\n]|\\(?:[abfnrtv\\'"0]|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{3})"""


def stripped(content: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(content, r"(?U)^\s+|\s+\z", "")


def literal_class(content: Column) -> Column:
    s = stripped(content)
    return (
        F.when(s == "", "EMPTY")
        .when(s.rlike(URL), "URL")
        .when(s.rlike(EMAIL), "EMAIL")
        .when(s.rlike(UUID), "UUID")
        .when(s.rlike(KEY_PREFIX), "KEY")
        .when(s.rlike(SQL), "SQL")
        .when(s.rlike(MIME) | s.rlike(SHORTHAND), "MSG")
        .when(s.rlike(PATH), "PATH")
        .when(s.rlike(KEY) & s.rlike("[^A-Za-z]"), "KEY")
        .otherwise("MSG")
    )


def sub_class(kind: Column, content: Column) -> Column:
    """A finer class; null where there is none."""
    s = stripped(content)
    return (
        F.when(kind == "URL", F.upper(F.regexp_extract(s, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)))
        .when((kind == "PATH") & ~s.rlike(r"^\.\.?/") & s.rlike(r"^(/|[A-Za-z]:[\\/])"), "ABSOLUTE")
        .when(kind == "PATH", "RELATIVE")
        .when(kind == "SQL", F.regexp_replace(F.upper(F.regexp_extract(s, SQL, 1)), " ", "_"))
        .when((kind == "MSG") & s.contains(" ") & s.rlike(r"[.!?]\z"), "USER-FACING")
        .when(kind == "MSG", "INTERNAL")
    )


def _segments(path: Column) -> Column:
    n = F.size(F.filter(F.split(path, r"[\\/]"), lambda p: p != ""))
    return F.concat(F.lit("/"), F.array_join(F.array_repeat(F.lit("<seg>"), n), "/"))


def skeleton(kind: Column, content: Column) -> Column:
    """The shape of a URL or path without its parts; null for others."""
    s = stripped(content)
    url_path = F.regexp_extract(s, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    host = F.when(F.regexp_extract(s, r"^[^:]+://([^/?#]*)", 1) != "", "HOST").otherwise("?")
    return F.when(kind == "URL", F.concat_ws(":", sub_class(kind, content), host, _segments(url_path))).when(kind == "PATH", _segments(s))


def placeholder(kind: Column, idx: Column, content: Column, level: int) -> Column:
    """The tag that takes a literal's place; higher levels say more."""
    i = idx.cast("string")
    parts = {0: [F.lit("LIT")], 1: [kind], 2: [kind, sub_class(kind, content)], 3: [kind, sub_class(kind, content), skeleton(kind, content)]}[level]
    return F.concat(F.lit("<"), F.concat_ws(":", *parts, i), F.lit(">"))


def tagged(literals: DataFrame, doc: str, pos: str, content: str, level: int = 1) -> DataFrame:
    """`literals` with class, idx and tag: equal contents of a document and class have one number, by first appearance."""
    from larkspur.operators.evaluation import first_appearance

    named = literals.withColumn("class", literal_class(F.col(content)))
    key = F.lit("LIT") if level == 0 else F.col("class")
    numbered = first_appearance(named.withColumn("_k", key), [doc, "_k"], content, pos, "idx").drop("_k")
    return numbered.withColumn("tag", placeholder(F.col("class"), F.col("idx"), F.col(content), level))


SINGLE_RUN = re.compile(r"(?s)'(?:\\.|[^'\\\n])*+")


@functools.cache
def _finder(kinds: tuple[int, ...]) -> re.Pattern:
    """The next literal of some kinds of quotes, or (as an empty group of the kind's name) a quote that nothing closes."""
    return re.compile("(?s)" + "|".join(f"{QUOTES[k][1].replace(')*', ')*+') if k > 1 else QUOTES[k][1]}|(?P<k{k}>(?={QUOTES[k][0]}))" for k in kinds))


def literal_spans(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each literal. A quote that nothing closes is looked at once, so time is linear.

    From such a quote on its kind is left out of the search; single quotes come back after the line, where they end.
    """
    kinds, back, at = tuple(range(len(QUOTES))), None, 0
    while kinds or back is not None:
        m = _finder(kinds).search(text, at) if kinds else None
        if back is not None and (m is None or m.start() >= back):
            kinds, at, back = tuple(sorted((*kinds, 3))), max(at, back), None
        elif m is None:
            return
        elif m.lastgroup:
            dead, at = int(m.lastgroup[1:]), m.start()
            kinds = tuple(k for k in kinds if k != dead)
            if dead == 3:
                back = SINGLE_RUN.match(text, at).end()
        else:
            yield m.span()
            at = m.end()


def cut_at_literals(text: Column) -> Column:
    """struct(between, literals): the pieces of a text around its literals, one more than these, and the literals with their quotes."""

    def one(t: str | None) -> tuple[list[str] | None, list[str]]:
        if t is None:
            return None, []
        spans = list(literal_spans(t))
        ends = [0, *(z for _, z in spans)]
        return [t[a:z] for a, z in zip(ends, [*(a for a, _ in spans), len(t)], strict=True)], [t[a:z] for a, z in spans]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from in_parts(lambda texts: pd.DataFrame([one(t) for t in texts], columns=["between", "literals"]))(batches)

    return F.pandas_udf(run, "between array<string>, literals array<string>")(text)


def unquoted(literal: Column) -> Column:
    """struct(content, quote) of a literal with its quotes."""
    n = F.when(literal.rlike(r"""(?s)^(\"{3}|'{3}).*\1\z""") & (F.length(literal) >= 6), 3).otherwise(1)
    return F.struct(F.substr(literal, n + 1, F.length(literal) - 2 * n).alias("content"), F.left(literal, n).alias("quote"))


def tag_texts(df: DataFrame, doc: str, text: str = "text", level: int = 1) -> DataFrame:
    """`df` and output (every literal replaced by its tag, in its quotes), literals_by_class and total_literals.

    Texts are cut at their literals, tags are made by expressions, and the pieces joined again. Single characters in
    single quotes stay. Equal contents of a class have one tag within a document.
    """
    df = df.withColumn("_cut", cut_at_literals(F.col(text)))
    found = df.select(doc, F.posexplode("_cut.literals").alias("pos", "literal")).withColumn("u", unquoted(F.col("literal")))
    found = found.select(doc, "pos", "u.content", "u.quote").where(~((F.col("quote") == "'") & F.col("content").rlike(f"^(?:{RUNE})\\z")))
    tags = tagged(found, doc, "pos", "content", level).select(doc, "pos", "class", F.concat("quote", "tag", "quote").alias("tag"))
    counts = tags.groupBy(doc, "class").agg(F.count("*").alias("n")).groupBy(doc).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("literals_by_class"))
    lists = tags.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("pos", "tag"))).alias("_tags"))
    out = df.join(lists, doc, "left").join(counts, doc, "left")
    pieces = F.transform("_cut.between", lambda x, i: F.concat(x, F.coalesce(F.try_element_at("_tags", i), F.get("_cut.literals", i), F.lit(""))))
    none = F.create_map().cast("map<string,bigint>")
    by_class = F.coalesce("literals_by_class", none)
    total = F.aggregate(F.map_values(by_class), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.withColumn("output", F.array_join(pieces, "")).withColumn("total_literals", total).withColumn("literals_by_class", by_class).drop("_tags", "_cut")


@udtf(returnType="pos int, start int, end int, quote string, content string")
class Literals:
    """Table function: a row for each literal of a text, for SQL: `SELECT ... FROM t, LATERAL literals_of(text)`."""

    def eval(self, text: str):
        for pos, (a, z) in enumerate(literal_spans(text or "")):
            n = 3 if z - a >= 6 and text[a : a + 3] in ('"""', "'''") else 1
            yield pos, a, z, text[a : a + n], text[a + n : z - n]


def register_functions(spark: SparkSession) -> None:
    """Names for SQL: the table function literals_of."""
    spark.udtf.register("literals_of", Literals)
