"""Readers of line formats. They take texts or lines as DataFrames, so that any source of text will do.

Lines: (file, n, line), n counting the lines of a file. Records: one text for each record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files. Whole files are rows, since a line's number needs the lines before it."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def nullable(x: Column) -> Column:
    """An empty text is null."""
    return F.nullif(F.trim(x), F.lit(""))


def iso_date(x: Column) -> Column:
    """YYYYMMDD with hyphens; anything else as it is."""
    return F.when(F.length(x) == 8, F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).otherwise(x)


# Columns of the fixed-width detail line as (name, first place from 1, length), and its read types.
DETAIL = (("service_point", 2, 10), ("meter", 12, 10), ("read_date", 22, 8), ("value", 30, 10), ("code", 40, 1), ("flag", 41, 1))
READ_TYPES = {"S": "SCHEDULED", "R": "RE-READ", "E": "ESTIMATED"}


def fixed_width(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads, problems) of files with a header H, details D and a trailer T that holds their number."""
    kind = F.substring("line", 1, 1)
    cols = [F.trim(F.substring("line", at, n)).alias(name) for name, at, n in DETAIL]
    reads = lines.where(kind == "D").select("file", "n", *cols)
    kinds = F.create_map(*[F.lit(x) for kv in READ_TYPES.items() for x in kv])
    reads = reads.withColumn("read_date", iso_date(F.col("read_date"))).withColumn("value", F.expr("try_cast(value as bigint)")).withColumn("read_type", F.try_element_at(kinds, F.col("code"))).withColumn("flag", F.col("flag") == "Y")
    counts = lines.where("line <> ''").groupBy("file").agg(
        F.min_by(kind, "n").alias("first"), F.max_by(kind, "n").alias("last"), F.count_if(kind == "D").alias("details"),
        F.max(F.when(kind == "T", F.expr("try_cast(trim(substring(line, 2, 8)) as bigint)"))).alias("said"), F.count_if(~kind.isin("H", "D", "T")).alias("strange"),
    )
    bad_codes = reads.where("read_type is null").groupBy("file").agg(F.count("*").alias("bad"))
    joined = counts.join(bad_codes, "file", "left")
    why = (
        F.when(F.col("first") != "H", "no header").when(F.col("last") != "T", "no trailer").when(F.col("strange") > 0, "unknown line")
        .when(~F.col("said").eqNullSafe(F.col("details")), "wrong count").when(F.coalesce("bad", F.lit(0)) > 0, "unknown read type")
    )
    return reads.drop("code"), joined.select("file", why.alias("problem")).where("problem is not null")


def blocks(lines: DataFrame, *starts: str) -> DataFrame:
    """(file, block, kind, n, key, value): `KEY value` lines, numbered by the block that a start line opens, whose key is its kind.

    A block ends with END or with the next one. Comments, blank lines and lines outside blocks go.
    """
    parts = lines.withColumn("line", F.trim(F.regexp_replace("line", "\r$", ""))).where("line <> '' and not startswith(line, '#')")
    keyed = parts.select("file", "n", F.split_part("line", F.lit(" "), F.lit(1)).alias("key"), F.trim(F.regexp_extract("line", r"^\S+(.*)$", 1)).alias("value"))
    opens = F.col("key").isin(*starts, "END")
    order = Window.partitionBy("file").orderBy("n")
    block = F.sum(opens.cast("int")).over(order)
    kind = F.last(F.when(opens, F.col("key")), ignorenulls=True).over(order)
    return keyed.withColumn("block", block).withColumn("kind", kind).where(F.col("kind").isin(*starts))


def _last(key: str) -> Column:
    """The last value of a key in a group of lines; null without one."""
    return F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("n")))


def _number(key: str, kind: str = "double") -> Column:
    return _last(key).try_cast(kind)


def stations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stations, channels) of blocks STA ... END. CHAN lines open channels, and each of a channel's EPOCH lines is a row.

    The end of an epoch OPEN is null. Epochs are numbered within their channel; those before any CHAN have no code.
    """
    rows = blocks(lines, "STA")
    heads = rows.groupBy("file", "block").agg(
        _last("STA").alias("station_id"), nullable(_last("NET")).alias("network_code"), nullable(_last("NAME")).alias("name"), _number("LAT").alias("latitude"), _number("LON").alias("longitude"),
        _number("ELEV").alias("elevation_m"), nullable(_last("OPERATOR")).alias("operator"), nullable(_last("STATUS")).alias("status"),
    )
    of_block = Window.partitionBy("file", "block").orderBy("n")
    rows = rows.withColumn("channel", F.sum((F.col("key") == "CHAN").cast("int")).over(of_block))
    settings = rows.groupBy("file", "block", "channel").agg(nullable(_last("CHAN")).alias("channel_code"), _number("RATE").alias("sample_rate_hz"), _number("AZIMUTH").alias("azimuth_deg"), _number("DIP").alias("dip_deg"), _number("DEPTH").alias("depth_m"))
    place = F.row_number().over(Window.partitionBy("file", "block", "channel").orderBy("n"))
    word = lambda i: F.split_part("value", F.lit(" "), F.lit(i))
    epochs = rows.where("key = 'EPOCH'").select("file", "block", "channel", place.alias("i"), word(1).alias("start"), F.nullif(nullable(word(2)), F.lit("OPEN")).alias("end"))
    named = epochs.join(settings, ["file", "block", "channel"]).join(heads.select("file", "block", "station_id"), ["file", "block"])
    channels = named.select(F.concat_ws("-", "station_id", "channel_code", "i").alias("channel_id"), "station_id", "channel_code", "sample_rate_hz", "azimuth_deg", "dip_deg", "depth_m", "start", "end")
    return heads.drop("block"), channels


# The kinds of blocks of a maintenance file, the column that a start line gives, and each key's column and type.
MAINTENANCE = {
    "AIRFRAME": ("tail_number", {"TYPE": ("type_designation", "string"), "OPERATOR": ("operator_code", "string"), "MANUFACTURED": ("manufactured_on", "string"), "HOURS": ("total_hours", "double"), "CYCLES": ("total_cycles", "bigint"), "STATUS": ("status", "string")}),
    "COMPONENT": ("component_id", {
        "TAIL": ("tail_number", "string"), "POSITION": ("position_code", "string"), "PARENT": ("parent_position_code", "string"), "CATEGORY": ("category", "string"), "LABEL": ("label", "string"), "PART": ("part_number", "string"),
        "SERIAL": ("serial_number", "string"), "INSTALLED": ("installed_on", "string"), "INSTALLED-HOURS": ("installed_hours", "double"), "INSTALLED-CYCLES": ("installed_cycles", "bigint"),
    }),
    "LIFE-LIMIT": ("part_number", {"LIMIT-HOURS": ("limit_hours", "double"), "LIMIT-CYCLES": ("limit_cycles", "bigint"), "LIMIT-DAYS": ("limit_calendar_days", "bigint")}),
    "DIRECTIVE": ("directive_id", {
        "TITLE": ("title", "string"), "ISSUED-BY": ("issued_by", "string"), "ISSUED": ("issued_on", "string"), "EFFECTIVE": ("effective_on", "string"), "CATEGORY": ("category", "string"), "INTERVAL-HOURS": ("interval_hours", "double"),
        "INTERVAL-CYCLES": ("interval_cycles", "bigint"), "INTERVAL-DAYS": ("interval_days", "bigint"),
    }),
    "COMPLIANCE": ("ids", {"DONE": ("complied_on", "string"), "METHOD": ("method", "string"), "NEXT-DUE": ("next_due_on", "string"), "STATUS": ("status", "string")}),
}


def maintenance(lines: DataFrame) -> dict[str, DataFrame]:
    """A table for each kind of block (lower-cased), and `applicability` of directives, with repeated APPLIES-* predicates.

    A serial range is `lo..hi`. The start line of COMPLIANCE has the ids of a directive and a component. Values that are
    no number where one belongs are null, and keys that a block doesn't have are passed over.
    """
    rows = blocks(lines, *MAINTENANCE)
    out = {}
    for kind, (head, keys) in MAINTENANCE.items():
        cols = [nullable(_last(k)).alias(c) if t == "string" else _number(k, t).alias(c) for k, (c, t) in keys.items()]
        out[kind.lower()] = rows.where(F.col("kind") == kind).groupBy("file", "block").agg(_last(kind).alias(head), *cols)
    ids = F.split("ids", r"\s+")
    out["compliance"] = out["compliance"].select("file", "block", nullable(F.get(ids, 0)).alias("directive_id"), F.get(ids, 1).alias("component_id"), *[c for c, _ in MAINTENANCE["COMPLIANCE"][1].values()])
    applies = rows.where("kind = 'DIRECTIVE' and key in ('APPLIES-TYPE', 'APPLIES-POSITION', 'APPLIES-PART', 'APPLIES-SERIAL')").join(out["directive"].select("file", "block", "directive_id"), ["file", "block"])
    serial = F.col("key") == "APPLIES-SERIAL"
    predicate = F.when(serial, "SERIAL_RANGE").otherwise(F.substr("key", F.lit(9)))
    low, high = F.split_part("value", F.lit(".."), F.lit(1)), F.split_part("value", F.lit(".."), F.lit(2))
    out["applicability"] = applies.select("directive_id", predicate.alias("predicate_type"), F.when(~serial, F.col("value")).alias("predicate_value"), F.when(serial, low).alias("serial_min"), F.when(serial, high).alias("serial_max"))
    return {name: df.drop("file", "block") for name, df in out.items()}


def directives(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directives, applicability) of a maintenance file."""
    out = maintenance(lines)
    return out["directive"], out["applicability"]


def tagged_records(records: DataFrame, text: str = "text") -> DataFrame:
    """`records` and `fields`: array of (tag, indicators, value, subs) of lines `=TAG  body`.

    Tags from 010 on have two indicators, then subfields `$x`; {dollar} stands for $. subs: code -> first value.
    """
    own = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"^=\w{3}  "))

    def field(line: Column) -> Column:
        tag, body = F.substring(line, 2, 3), F.regexp_replace(line, r"^=\w{3}  ", "")
        data = tag >= "010"
        subs = F.filter(F.split(F.substr(body, F.lit(3)), r"\$"), lambda s: s != "")
        entries = F.transform(subs, lambda s: F.struct(F.substring(s, 1, 1).alias("code"), F.replace(F.substr(s, F.lit(2)), F.lit("{dollar}"), F.lit("$")).alias("value")))
        return F.struct(tag.alias("tag"), F.when(data, F.substring(body, 1, 2)).alias("indicators"), F.when(~data, body).alias("value"), F.when(data, entries).alias("subs"))

    return records.withColumn("fields", F.transform(own, field))


def field_value(fields: Column, tag: str, code: str | None = None) -> Column:
    """The first field of a tag, or its first subfield of a code; null if there is none."""
    first = F.try_element_at(F.filter(fields, lambda f: f["tag"] == tag), F.lit(1))
    if code is None:
        return first["value"]
    return F.try_element_at(F.filter(first["subs"], lambda s: s["code"] == code), F.lit(1))["value"]


def holding(fields: Column) -> Column:
    """struct of a catalogue record from its fields (as of `tagged_records`), with its loans and reservations.

    Of repeated fields the last counts, of repeated subfields the first. Lines 583 after a line 876 are events of that
    loan; a policy code may come with the loan or with any line after it.
    """
    none = F.array().cast("array<struct<code:string,value:string>>")
    placed = F.transform(fields, lambda f, i: F.struct(i.alias("i"), f["tag"].alias("tag"), f["value"].alias("value"), F.coalesce(f["subs"], none).alias("subs")))
    # Bound by a lambda, so that it is made once and not wherever it is named.
    return F.get(F.transform(F.array(placed), _holding), 0)


def _holding(placed: Column) -> Column:
    sub_of = lambda f, c: F.coalesce(F.try_element_at(F.filter(f["subs"], lambda s: s["code"] == c), F.lit(1))["value"], F.lit(""))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    of = lambda *tags: F.filter(placed, lambda f: f["tag"].isin(*tags))
    got = lambda tag, c: sub_of(last(of(tag)), c)
    bare = lambda x, end: F.regexp_replace(x, f"{end}$", "")
    title, desk, issued = last(F.filter(of("245"), lambda f: F.size(f["subs"]) > 0))["subs"], last(of("270"))["subs"], last(of("260", "264"))
    shelf = F.flatten(F.transform(of("852"), lambda f: f["subs"]))
    on_shelf = lambda c: F.coalesce(last(F.filter(shelf, lambda s: s["code"] == c))["value"], F.lit(""))
    call = F.aggregate(shelf, F.lit(""), lambda a, s: F.when(s["code"] == "h", s["value"]).when(s["code"] == "i", F.trim(F.concat(a, F.lit(" "), s["value"]))).otherwise(a))
    branch_at = lambda i: F.trim(F.coalesce(last(F.filter(of("852"), lambda f: (f["i"] < i) & (sub_of(f, "a") != "")))["subs"][0]["value"], F.lit("")))

    def loan(f: Column) -> Column:
        end = F.coalesce(F.try_element_at(F.filter(of("876"), lambda g: g["i"] > f["i"]), F.lit(1))["i"], F.size(placed))
        after = F.filter(placed, lambda g: (g["i"] > f["i"]) & (g["i"] < end))
        event = lambda name: iso_date(sub_of(last(F.filter(after, lambda g: (g["tag"] == "583") & (F.size(g["subs"]) >= 3) & (sub_of(g, "b") == "D8") & (sub_of(g, "a") == name))), "c"))
        policy = F.try_element_at(F.filter(F.transform(F.concat(F.array(f), after), lambda g: sub_of(g, "x")), lambda x: x != ""), F.lit(1))
        return F.struct(
            sub_of(f, "a").alias("item_id"), sub_of(f, "h").alias("type"), sub_of(f, "j").alias("level"), F.coalesce(policy, F.lit("")).alias("policy_code"), sub_of(f, "3").alias("borrower_id"), branch_at(f["i"]).alias("pickup_branch"),
            event("LOANSTART").alias("effective_start"), event("LOANEND").alias("effective_end"),
        )

    held = F.filter(of("583"), lambda g: sub_of(g, "a") == "HOLDPLACED")
    return F.struct(
        F.trim(F.coalesce(last(of("001"))["value"], F.lit(""))).alias("holding_id"), got("020", "a").alias("isbn"), bare(got("100", "a"), ",").alias("author"), bare(F.trim(F.coalesce(F.get(title, 0)["value"], F.lit(""))), " /").alias("title"),
        F.coalesce(F.get(title, 1)["value"], F.lit("")).alias("statement"), iso_date(F.trim(sub_of(issued, "c"), F.lit("."))).alias("published"), bare(sub_of(issued, "b"), ",").alias("imprint"),
        F.regexp_replace(F.coalesce(F.get(desk, 1)["value"], F.lit("")), "[^0-9]", "").alias("desk_phone"), got("590", "a").alias("circ_status"), bare(got("650", "a"), r"\.").alias("collection_code"), F.trim(on_shelf("a")).alias("branch_id"),
        on_shelf("b").alias("room"), on_shelf("c").alias("wing"), call.alias("call_number"), on_shelf("j").alias("bin"), F.transform(of("876"), loan).alias("loans"),
        F.transform(held, lambda g: F.struct(sub_of(g, "3").alias("borrower_id"), branch_at(g["i"]).alias("pickup_branch"), iso_date(sub_of(g, "c")).alias("placed_on"))).alias("reservations"),
    )


def shift_blocks(records: DataFrame, text: str = "text") -> DataFrame:
    """(run, status, type, severity, meters, note): DEFECT lines of `KEY: value` blocks parted by blank lines.

    A line that begins with two blanks goes on with the line before.
    """
    flat = F.regexp_replace(F.col(text), "\n  +", " ")
    blocks_ = records.select(F.explode(F.split(flat, "\n\n+")).alias("b")).where("b <> ''")
    value = lambda k: F.nullif(F.regexp_extract("b", rf"(?m)^{k}: *(.*)$", 1), F.lit(""))
    defect = F.explode_outer(F.regexp_extract_all("b", F.lit(r"(?m)^DEFECT: *(.*)$"), F.lit(1)))
    rows = blocks_.select(value("RUN").alias("run"), value("STATUS").alias("status"), defect.alias("d"))
    part = lambda i: F.regexp_extract("d", r"^(\w+) SEV([1-3]) AT ([0-9.]+)M(?: NOTE=(.*))?$", i)
    return rows.select("run", "status", part(1).alias("type"), F.expr("try_cast(regexp_extract(d, 'SEV([1-3])', 1) as int)").alias("severity"), F.expr("try_cast(regexp_extract(d, 'AT ([0-9.]+)M', 1) as double)").alias("meters"), nullable(part(4)).alias("note"))


def length_tagged(text: Column, tags: tuple[str, ...]) -> Column:
    """struct of `tags` from `<tag:length>value...<fin>`: bad tags are passed over, lengths end with the line at the latest."""

    def one(line: str | None) -> dict[str, str | None]:
        out: dict[str, str | None] = dict.fromkeys(tags)
        at, line = 0, line or ""
        while (a := line.find("<", at)) >= 0 and (z := line.find(">", a)) >= 0:
            name, _, n = line[a + 1 : z].partition(":")
            if name == "fin":
                break
            if not (n.isascii() and n.isdigit()):
                at = a + 1
                continue
            if name in out:
                out[name] = line[z + 1 : z + 1 + int(n)]
            at = z + 1 + int(n)
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lines in batches:
            yield pd.DataFrame([one(x) for x in lines], columns=list(tags))

    return F.pandas_udf(run, ", ".join(f"{t} string" for t in tags))(text)


def headings(text: Column) -> Column:
    """array of (title, body) of the `## ` sections of a template, without a comment at its beginning."""
    bare = F.regexp_replace(text, r"(?s)^\s*<!--.*?-->\s*", "")
    parts = F.split(bare, "(?m)^## ")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    return F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("\n"), F.lit(1)).alias("title"), F.regexp_replace(p, r"^[^\n]*\n?", "").alias("body")))
