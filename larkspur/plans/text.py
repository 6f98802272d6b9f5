"""Queries over texts: manifests, literals, pseudonyms, counters, similarity, and the line formats, whose texts Spark makes of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import catalogue, code, identifiers, literals, registry, similarity, stats
from larkspur.sources import formats
from larkspur.sources.tables import table

from .registry import query

# A key for the queries, so that results can be compared; operators take any.
KEY = bytes(range(16))


@query("s02_manifest", "SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines, split_part(source, 'c', 2) AS domain FROM documents")
def s02(spark: SparkSession, sf: str) -> DataFrame:
    """Hash, size, lines and domain of each text."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), code.line_count(text).alias("lines"), F.split_part("source", F.lit("c"), F.lit(2)).alias("domain"))


@query("s03_envelope", "SELECT source, count(*) FILTER (n_chars BETWEEN 400 AND 4000) AS kept, count(*) FILTER (n_chars NOT BETWEEN 400 AND 4000) AS dropped FROM documents GROUP BY source")
def s03(spark: SparkSession, sf: str) -> DataFrame:
    """Texts within an envelope and how many are not."""
    inside = F.col("n_chars").between(400, 4000)
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


@query("s07_table_rows", r"WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT source, regexp_extract(line, '^([A-Za-z]+) \| ([A-Za-z]+) \|', 1) AS a FROM l) SELECT source, a AS symbol, count(*) AS n FROM r WHERE a <> '' GROUP BY ALL")
def s07(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols in the first cells of table rows."""
    rows = table(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return rows.select("source", F.regexp_extract("line", r"^([A-Za-z]+) \| ([A-Za-z]+) \|", 1).alias("symbol")).where("symbol <> ''").groupBy("source", "symbol").agg(F.count("*").alias("n"))


@query("s18_listing", "SELECT p_brand, count(*) FILTER (p_size > 10) AS live, max(p_size) FILTER (p_size > 10) AS most, min(p_retailprice) FILTER (p_size > 10) AS cheapest FROM part GROUP BY p_brand")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """Live providers of each model, the largest context and the least price."""
    live = F.col("p_size") > 10
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(live).alias("live"), F.max(F.when(live, F.col("p_size"))).alias("most"), F.min(F.when(live, F.col("p_retailprice"))).alias("cheapest"))


@query("p15_size_from_name", r"WITH m AS (SELECT p_partkey, p_name || '-' || p_size || CASE WHEN p_partkey % 3 = 0 THEN 'x7b' ELSE 'b' END AS model FROM part) SELECT p_partkey, (CASE WHEN regexp_matches(model, '[0-9]+x[0-9]+b$') THEN regexp_extract(model, '([0-9]+)x', 1)::BIGINT * regexp_extract(model, 'x([0-9]+)b', 1)::BIGINT ELSE regexp_extract(model, '([0-9]+)b$', 1)::BIGINT END) AS billions FROM m")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes read from names, products of experts included."""
    model = F.concat("p_name", F.lit("-"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "x7b").otherwise("b"))
    num = lambda p: F.regexp_extract(F.col("model"), p, 1).cast("long")
    size = F.when(F.col("model").rlike("[0-9]+x[0-9]+b$"), num("([0-9]+)x") * num("x([0-9]+)b")).otherwise(num("([0-9]+)b$"))
    return table(spark, sf, "part").select("p_partkey", model.alias("model")).select("p_partkey", size.alias("billions"))


LITERALS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, '"([^"<>]*)"', 1)) AS s, unnest(range(len(regexp_extract_all(html, '"([^"<>]*)"', 1)))) AS pos FROM pages UNION ALL SELECT page_id, url, 1000000 FROM pages)"""
CLASSES = r"""c AS (SELECT *, CASE WHEN t = '' THEN 'EMPTY' WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s]+$') THEN 'URL' WHEN regexp_matches(t, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$') THEN 'EMAIL'
  WHEN regexp_matches(t, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 'UUID' WHEN regexp_matches(t, '^(sk_|pk_|ghp_|ghs_|AKIA|ASIA|xox[abp]-|AIza)[A-Za-z0-9_\-]{8,}$') THEN 'KEY'
  WHEN regexp_matches(t, '(?i)\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|CREATE\s+TABLE)\b') THEN 'SQL'
  WHEN regexp_matches(t, '(?i)^(application|audio|font|image|message|model|multipart|text|video)/((vnd|prs|x)\.[A-Za-z0-9.+\-]+|[A-Za-z0-9+\-]+)(\s*;.*)?$') OR regexp_matches(t, '(?i)^([0-9]+(/[0-9]+)+|and/or|n/a|km/h|mi/h|yes/no|on/off|true/false|w/o|he/she)$') THEN 'MSG'
  WHEN regexp_matches(t, '^(/|\./|\.\./|~/|[A-Za-z]:[\\/]|[A-Za-z0-9_.\-]+/)[\p{L}\p{N}_./\\\-]*$') THEN 'PATH' WHEN regexp_matches(t, '^[A-Za-z0-9+/=_\-]{32,}$') AND regexp_matches(t, '[^A-Za-z]') THEN 'KEY' ELSE 'MSG' END AS class
  FROM (SELECT *, regexp_replace(s, '^\s+|\s+$', '', 'g') AS t FROM l))"""


def page_literals(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, pos, s): quoted strings of the pages, and their addresses."""
    pages = table(spark, sf, "pages")
    quoted = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('"([^"<>]*)"'), F.lit(1))).alias("pos", "s"))
    return quoted.union(pages.select("page_id", F.lit(1_000_000).alias("pos"), F.col("url").alias("s")))


@query("t08_literal_classes", f"WITH {LITERALS}, {CLASSES} SELECT class, count(*) AS n FROM c GROUP BY class")
def t08(spark: SparkSession, sf: str) -> DataFrame:
    """Literals by class."""
    return page_literals(spark, sf).groupBy(literals.literal_class(F.col("s")).alias("class")).agg(F.count("*").alias("n"))


@query(
    "t11_tagged_literals",
    rf"""WITH {LITERALS}, {CLASSES}, f AS (SELECT *, min(pos) OVER (PARTITION BY page_id, class, s) AS first FROM c), i AS (SELECT *, dense_rank() OVER (PARTITION BY page_id, class ORDER BY first) - 1 AS idx FROM f),
    b AS (SELECT *, CASE WHEN class = 'URL' THEN upper(split_part(t, ':', 1)) WHEN class = 'PATH' THEN CASE WHEN NOT regexp_matches(t, '^\.\.?/') AND regexp_matches(t, '^(/|[A-Za-z]:[\\/])') THEN 'ABSOLUTE' ELSE 'RELATIVE' END
      WHEN class = 'SQL' THEN replace(upper(regexp_extract(t, '(?i)\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|CREATE\s+TABLE)\b', 1)), ' ', '_') WHEN class = 'MSG' THEN CASE WHEN contains(t, ' ') AND regexp_matches(t, '[.!?]$') THEN 'USER-FACING' ELSE 'INTERNAL' END END AS sub,
      CASE WHEN class = 'URL' THEN regexp_extract(t, '^[^:]+://[^/?#]*([^?#]*)', 1) WHEN class = 'PATH' THEN t END AS p FROM i),
    k AS (SELECT *, CASE WHEN p IS NOT NULL THEN CASE WHEN class = 'URL' THEN sub || ':' || CASE WHEN regexp_extract(t, '^[^:]+://([^/?#]*)', 1) <> '' THEN 'HOST' ELSE '?' END || ':' ELSE '' END || '/' || array_to_string([ '<seg>' for x in regexp_split_to_array(p, '[\\/]') if x <> ''], '/') END AS skel FROM b)
    SELECT page_id, pos, '<' || concat_ws(':', class, sub, skel, idx::VARCHAR) || '>' AS tag FROM k""",
)
def t11(spark: SparkSession, sf: str) -> DataFrame:
    """Tags with sub-class and skeleton, numbered by first appearance."""
    return literals.tagged(page_literals(spark, sf), "page_id", "pos", "s", 3).select("page_id", F.col("pos").cast("long").alias("pos"), "tag")


@query("t12_literal_tagging")
def t12(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages with the literals of all five kinds of quotes replaced by tags."""
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    got = registry.transform(pages, "tag-literals", doc="page_id")
    return got.select("page_id", F.length("output").alias("n_chars"), F.sha2("output", 256).alias("output_sha256"), "total_literals", F.to_json("literals_by_class").alias("by_class"))


@query("t32_composed")
def t32(spark: SparkSession, sf: str) -> DataFrame:
    """Pages through both transforms in turn."""
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    got = registry.transform(pages, "composed", doc="page_id", key=KEY)
    return got.select("page_id", F.sha2("output", 256).alias("output_sha256"), F.array_join("chain", ",").alias("chain"))


@query("t07_pseudonymised")
def t07(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of each document under a key, and the way back (T01 - T07, T13); the map doesn't leave the task."""
    p = table(spark, sf, "documents").select("doc_id", "text", identifiers.checked(F.col("text"), KEY).alias("p"))
    return p.select("doc_id", "p.replaced", "p.distinct", "p.collisions", (F.length("p.output") == F.length("text")).alias("same_length"), "p.round_trip")


@query("t15_similarity_gate")
def t15(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each turn survives in the next, and the verdict (T14 - T17). Every third turn imports the module that its conversation is named after."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf, "conversations").select("conv_id", "turn", "text", after.alias("after")).where("after is not null")
    own = F.concat(F.lit('package a\nimport (\n\t"turn'), "conv_id", F.lit('/store"\n)\n'), F.coalesce("text", F.lit("")))
    named = F.concat("after", F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" TURN"), "conv_id")).otherwise(""))
    got = pairs.select("conv_id", "turn", similarity.report(own, named).alias("r"), similarity.leaked(own, named).alias("leaked"))
    return got.select("conv_id", "turn", "r.*", "leaked", similarity.gate(F.col("r"), F.col("leaked")).alias("verdict"))


@query(
    "t16_leaked_modules",
    """WITH p AS (SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after, turn % 3 AS k FROM conversations)
    SELECT conv_id, turn, k = 1 AS leaked FROM p WHERE after IS NOT NULL""",
)
def t16(spark: SparkSession, sf: str) -> DataFrame:
    """Which turns name the module that the turn before imports."""
    return t15(spark, sf).select("conv_id", "turn", "leaked")


@query(
    "t18_suffix",
    """WITH t AS (SELECT page_id, 0 AS kind, html AS text FROM pages UNION ALL SELECT page_id, 1, replace(html, 'def ', '') || 'const ' FROM pages UNION ALL SELECT page_id, 2, '// ' || replace(html, chr(10), ' ') || chr(10) || 'package page // import "page"' || chr(10) FROM pages UNION ALL SELECT page_id, 3, 'package page; func ' || html FROM pages),
    h AS (SELECT *, left(text, 4000) AS head FROM t)
    SELECT page_id, kind, CASE WHEN (contains(head, 'package ') AND contains(head, 'func ')) OR len(list_filter(string_split(head, chr(10)), lambda x: regexp_full_match(x, 'package\\s+[A-Za-z_][A-Za-z0-9_]*\\s*(//.*)?'))) > 0 THEN '.go'
    WHEN (contains(head, '=> ') OR contains(head, 'const ') OR contains(head, 'interface ') OR contains(head, 'export ') OR contains(head, 'function ')) AND NOT contains(head, 'def ') THEN '.ts' ELSE '.py' END AS suffix FROM h""",
)
def t18(spark: SparkSession, sf: str) -> DataFrame:
    """A suffix from the look of a text's head: pages as they are, with a mark of TypeScript at the end, after a clause with a comment, and with one on the first line."""
    pages, html = table(spark, sf, "pages"), F.col("html")
    kinds = (html, F.concat(F.replace(html, F.lit("def "), F.lit("")), F.lit("const ")), F.concat(F.lit("// "), F.replace(html, F.lit("\n"), F.lit(" ")), F.lit('\npackage page // import "page"\n')), F.concat(F.lit("package page; func "), html))
    texts = pages.select("page_id", F.posexplode(F.array(*kinds)).alias("kind", "text"))
    return texts.select("page_id", "kind", code.suffix(F.col("text")).alias("suffix"))


@query("t19_target", "SELECT doc_id, ((('0x' || substr(sha256(text), 1, 16))::UBIGINT) % 9)::BIGINT AS target FROM documents")
def t19(spark: SparkSession, sf: str) -> DataFrame:
    """A choice of nine by a text's hash."""
    return table(spark, sf, "documents").select("doc_id", code.target(F.col("text")).cast("long").alias("target"))


@query("t22_reply", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def t22(spark: SparkSession, sf: str) -> DataFrame:
    """Objects read from replies that may have text around them."""
    wrapped = F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone."))
    return table(spark, sf, "events").select("event_id", code.reply(wrapped, "k int")["k"].alias("k"))


def counters_sql(text: str, family: str) -> dict[str, str]:
    """The nine counters in SQL, from the patterns of the library."""
    n = lambda p: f"len(regexp_extract_all({text}, '{p.replace(chr(39), chr(39) * 2)}'))::BIGINT"
    braces = f"regexp_extract_all({text}, '[{{}}]')"
    sums = f"list_transform(range(1, len({braces}) + 1), lambda i: list_sum(list_transform({braces}[1:i], lambda x: CASE x WHEN '{{' THEN 1 ELSE -1 END)))"
    depth = f"coalesce(list_max(list_transform(range(1, len({braces}) + 1), lambda i: ({sums})[i] - least(0, list_min(({sums})[1:i])))), 0)::BIGINT"
    lines = f"(length({text}) - length(replace({text}, chr(10), '')) + CASE WHEN {text} <> '' AND NOT ends_with({text}, chr(10)) THEN 1 ELSE 0 END)::BIGINT"
    own = {name: n(p) for name, p in code.COUNTERS[family].items()}
    return {"lines": lines, "bytes": f"strlen({text})::BIGINT", **own, "imports": n(code.IMPORTS), "exports": n(code.EXPORTS), "string_literals": n(code.STRINGS), "max_brace_depth": depth}


@query("t23_counters", f"SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in counters_sql('html', 'ts').items())} FROM pages")
def t23(spark: SparkSession, sf: str) -> DataFrame:
    """Structural counters of pages."""
    return table(spark, sf, "pages").select("page_id", *code.counters(F.col("html"), "ts"))


@query("t23_counters_plain", r"""SELECT page_id, (length(html) - length(replace(html, chr(10), '')) + CASE WHEN html <> '' AND NOT ends_with(html, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines, strlen(html)::BIGINT AS bytes, len(regexp_extract_all(html, '\bclass\s+\w+'))::BIGINT AS structs, len(regexp_extract_all(html, '"(?:[^"\\]|\\.)*"'))::BIGINT AS quoted FROM pages""")
def t23_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Those counters that SQL has too."""
    html = F.col("html")
    return table(spark, sf, "pages").select("page_id", code.line_count(html).alias("lines"), F.octet_length(html).cast("long").alias("bytes"), code.matches(html, code.COUNTERS["ts"]["structs"]).alias("structs"), code.matches(html, r'"(?:[^"\\]|\\.)*"').alias("quoted"))


SHAPE_SQL = ", ".join(f"""len([x for x in l if regexp_matches(x, '{p}')])::BIGINT AS "{name}\"""" for name, p in code.SHAPE.items())


@query(
    "t28_shape",
    rf"""WITH p AS (SELECT doc_id, [trim(x, chr(32)) for x in regexp_split_to_array(text, '\r\n|[\n\r]')] AS l FROM documents),
    c AS (SELECT doc_id, [CASE WHEN regexp_matches(x, '["`]') THEN x ELSE rtrim(split_part(x, '//', 1), chr(32)) END for x in l if NOT regexp_matches(x, '^(//|\*|/\*)')] AS l FROM p), d AS (SELECT doc_id, [x for x in l if x <> ''] AS l FROM c)
    SELECT doc_id, {SHAPE_SQL} FROM d""",
)
def t28(spark: SparkSession, sf: str) -> DataFrame:
    """A census of the kinds of code lines. (The SQL has no comments of several lines, nor have the texts.)"""
    docs = table(spark, sf, "documents").select("doc_id", code.code_lines(F.col("text")).alias("lines"))
    return docs.select("doc_id", *code.shape(F.col("lines")))


@query("t33_reversed", "SELECT doc_id, reverse(text) AS output FROM documents")
def t33(spark: SparkSession, sf: str) -> DataFrame:
    """The text backwards, through the registry of transforms."""
    return registry.transform(table(spark, sf, "documents").select("doc_id", "text"), "reverse-text").select("doc_id", "output")


@query("x04_kinds_equal", "SELECT conv_id, list_sort(list(role) FILTER (turn % 2 = 0)) = list_sort(list(role) FILTER (turn % 2 = 1)) AS same_kinds FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def x04(spark: SparkSession, sf: str) -> DataFrame:
    """Multisets of kinds compared by their counts."""
    side = lambda k: F.sort_array(F.collect_list(F.when(F.col("turn") % 2 == k, F.col("role"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), (side(0) == side(1)).alias("same_kinds")).where("n > 1").select("conv_id", "same_kinds")


@query("m01_haversine", "SELECT c_custkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT c_custkey, power(sin(radians(c_custkey % 60) / 2), 2) + cos(radians(10)) * cos(radians(10 + c_custkey % 60)) * power(sin(radians(c_nationkey * 3) / 2), 2) AS a FROM customer)")
def m01(spark: SparkSession, sf: str) -> DataFrame:
    """Great-circle distances."""
    k = F.col("c_custkey") % 60
    km = stats.haversine(F.lit(10.0), F.lit(0.0), F.lit(10.0) + k, F.col("c_nationkey") * 3.0)
    return table(spark, sf, "customer").select("c_custkey", F.round(km, 6).alias("km"))


@query("h01_blob_ids", "SELECT doc_id, sha1(encode('blob ' || strlen(text)) || '\\x00'::BLOB || encode(text)) AS oid FROM documents")
def h01(spark: SparkSession, sf: str) -> DataFrame:
    """Object ids that version control gives the texts."""
    return table(spark, sf, "documents").select("doc_id", code.blob_id(F.col("text")).alias("oid"))


@query("s11_tagged_records", "SELECT p_partkey AS id, p_name || ' $5' AS title, p_brand AS subtitle FROM part")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged records with indicators, subfields and escapes, made of parts."""
    text = F.concat(F.lit("=001  "), F.col("p_partkey").cast("string"), F.lit("\n=245  10$a"), "p_name", F.lit(" {dollar}5$b"), "p_brand", F.lit("\n"))
    # The table is small and its records take long: few tasks would read it.
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    parsed = formats.tagged_records(parts.select(text.alias("text")))
    f = F.col("fields")
    return parsed.select(formats.field_value(f, "001").cast("long").alias("id"), formats.field_value(f, "245", "a").alias("title"), formats.field_value(f, "245", "b").alias("subtitle"))


@query("s12_length_tagged", "SELECT event_id::VARCHAR AS id, event_type AS kind, props FROM events")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """Length-tagged lines with a bad tag among them, made of events."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}:"), F.length(c).cast("string"), F.lit(">"), c)
    line = F.concat(tag("id", F.col("event_id").cast("string")), F.lit("<bad:x>"), tag("kind", F.col("event_type")), tag("props", F.col("props")), F.lit("<fin>"))
    return table(spark, sf, "events").select(formats.length_tagged(line, ("id", "kind", "props")).alias("r")).select("r.*")


@query("s13_fixed_width", "SELECT lpad(l_orderkey::VARCHAR, 10, '0') AS service_point, strftime(l_shipdate, '%Y-%m-%d') AS read_date, l_quantity::BIGINT AS value, CASE l_returnflag WHEN 'A' THEN 'SCHEDULED' WHEN 'R' THEN 'RE-READ' ELSE 'ESTIMATED' END AS read_type, l_linestatus = 'F' AS flag FROM lineitem")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-width reads, made of order lines."""
    lines = table(spark, sf, "lineitem")
    pad = lambda c: F.lpad(c.cast("string"), F.lit(10), F.lit("0"))
    kind = F.when(F.col("l_returnflag") == "A", "S").when(F.col("l_returnflag") == "R", "R").otherwise("E")
    text = F.concat(F.lit("D"), pad(F.col("l_orderkey")), pad(F.col("l_partkey")), F.date_format("l_shipdate", "yyyyMMdd"), pad(F.col("l_quantity").cast("long")), kind, F.when(F.col("l_linestatus") == "F", "Y").otherwise("N"))
    reads, _ = formats.fixed_width(lines.select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("n"), text.alias("line")))
    return reads.select("service_point", "read_date", "value", "read_type", "flag")


@query("s14_station_blocks", "SELECT 'C' || o_custkey || '-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS channel_id, strftime(o_orderdate, '%Y-%m-%d') AS start, CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS \"end\" FROM orders")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """Station blocks with repeated epochs, made of customers and orders, a file for each customer."""
    orders = table(spark, sf, "orders")
    end = F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise(F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd"))
    epochs = orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("n"), F.concat_ws(" ", F.lit("EPOCH"), F.date_format("o_orderdate", "yyyy-MM-dd"), end).alias("line"))
    heads = orders.select(F.col("o_custkey").alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("n"), F.concat(F.lit("STA C"), F.col("file").cast("string")).alias("line"))
    return formats.stations(heads.union(epochs))[1].select("channel_id", "start", "end")


@query("s15_shift_blocks", "SELECT 'R' || o_orderkey AS run, o_orderstatus AS status, 'SNAG' AS type, (o_orderkey % 3 + 1)::INT AS severity, o_orderkey % 100 + 0.5 AS meters, 'left edge torn' AS note FROM orders")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """Shift reports with continued lines, made of orders."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("RUN: R"), k.cast("string"), F.lit("\nSTATUS: "), "o_orderstatus", F.lit("\nDEFECT: SNAG SEV"), (k % 3 + 1).cast("string"), F.lit(" AT "), (k % 100).cast("string"), F.lit(".5M NOTE=left edge\n  torn\n\n"))
    return formats.shift_blocks(table(spark, sf, "orders").select(text.alias("text")))


@query("s16_directive_blocks", "SELECT 'D' || p_partkey AS directive_id, 'PART' AS predicate_type, p_brand AS predicate_value, NULL AS serial_min, NULL AS serial_max FROM part UNION ALL SELECT 'D' || p_partkey, 'SERIAL_RANGE', NULL, p_size::VARCHAR, (p_size + 10)::VARCHAR FROM part")
def s16(spark: SparkSession, sf: str) -> DataFrame:
    """Directive blocks with repeated predicates, made of parts, a file for each part."""
    body = F.array(F.concat(F.lit("DIRECTIVE D"), F.col("p_partkey").cast("string")), F.concat(F.lit("APPLIES-PART "), "p_brand"), F.concat(F.lit("APPLIES-SERIAL "), F.col("p_size").cast("string"), F.lit(".."), (F.col("p_size") + 10).cast("string")), F.lit("END"))
    lines = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), "p_partkey", F.posexplode(body).alias("i", "line")).select("file", (F.col("p_partkey") * 10 + F.col("i")).alias("n"), "line")
    return formats.directives(lines)[1]


@query(
    "s11_holdings",
    """SELECT p_partkey::VARCHAR AS holding_id, p_name AS title, p_brand AS author, strftime(DATE '2020-01-01' + (p_partkey % 300)::INT, '%Y-%m-%d') AS published, 'B' || p_size AS branch_id, 'QA ' || p_size || ' x' AS call_number, 'P' || (p_partkey % 7) AS policy_code,
    '2021-02-03' AS effective_start, CASE WHEN p_partkey % 2 = 0 THEN '2021-03-04' ELSE '' END AS effective_end, 1 AS reservations FROM part""",
)
def s11_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue records with a loan, its events, a reservation, repeated and malformed lines, made of parts."""
    key, c = F.col("p_partkey"), lambda x: F.col(x).cast("string")
    lines = [
        F.lit("=LDR  00000cam"), F.concat(F.lit("=001  "), c("p_partkey")), F.lit("no tag at all"), F.lit("=12"), F.lit("=245  10$aan earlier title /"), F.concat(F.lit("=100  1\\\\$a"), "p_brand", F.lit(",")), F.concat(F.lit("=245  10$a"), "p_name", F.lit(" /$ba statement")),
        F.concat(F.lit("=264  \\\\1$bpress,$c"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 300).cast("int")), "yyyyMMdd"), F.lit(".")), F.concat(F.lit("=852  \\\\\\\\$aB"), c("p_size"), F.lit("$hQA$i"), c("p_size"), F.lit("$ix")),
        F.lit("=876  \\\\\\\\$aitem$hloan"), F.concat(F.lit("=583  \\\\\\\\$aLOANSTART$bD8$c20210203$xP"), (key % 7).cast("string")), F.when(key % 2 == 0, F.lit("=583  \\\\\\\\$aLOANEND$bD8$c20210304")).otherwise(F.lit("=583  \\\\\\\\$aLOANEND$bD8")),
        F.lit("=583  \\\\\\\\$aHOLDPLACED$c20210101$3someone"),
    ]
    # The table is small and its records take long: few tasks would read it.
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    parsed = formats.tagged_records(parts.select(F.concat_ws("\n", *lines).alias("text"))).select(formats.holding(F.col("fields")).alias("h"))
    loan = F.get("h.loans", 0)
    return parsed.select("h.holding_id", "h.title", "h.author", "h.published", "h.branch_id", "h.call_number", loan["policy_code"].alias("policy_code"), loan["effective_start"].alias("effective_start"), loan["effective_end"].alias("effective_end"), F.size("h.reservations").alias("reservations"))


@query(
    "s14_channels",
    """SELECT 'S' || s_suppkey || '-' || c || '-' || e AS channel_id, CASE c WHEN 'BHZ' THEN 20.0 END AS sample_rate_hz, '20' || (10 + e) AS start, CASE e WHEN 1 THEN '2012' END AS "end", s_acctbal AS latitude
    FROM supplier, (SELECT unnest(['BHZ', 'LHZ']) AS c), (SELECT unnest([1, 2]) AS e)""",
)
def s14_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Stations with two channels of two epochs each, comments and bad numbers, made of suppliers, a file for each."""
    key = F.col("s_suppkey").cast("string")
    body = [F.lit("RATE 1"), F.lit("# a comment"), F.concat(F.lit("STA S"), key), F.concat(F.lit("LAT "), F.col("s_acctbal").cast("string")), F.lit("ELEV high"), F.lit("CHAN BHZ"), F.lit("RATE 20"), F.lit("EPOCH 2011 2012"), F.lit("EPOCH 2012 OPEN"), F.lit("CHAN LHZ"), F.lit("RATE fast"), F.lit("EPOCH 2011 2012"), F.lit("EPOCH 2012"), F.lit("END"), F.lit("EPOCH 1 2")]
    lines = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file"), F.posexplode(F.array(*body)).alias("n", "line"))
    heads, channels = formats.stations(lines)
    return channels.join(heads.select("station_id", "latitude"), "station_id").select("channel_id", "sample_rate_hz", "start", "end", "latitude")


@query(
    "s16_maintenance",
    """SELECT 'airframe' AS kind, 'N' || p_partkey AS id, p_type AS a, p_size::DOUBLE AS x FROM part UNION ALL SELECT 'component', 'C' || p_partkey, 'N' || p_partkey, NULL FROM part UNION ALL SELECT 'life-limit', 'P' || p_partkey, NULL, p_size + 0.5 FROM part
    UNION ALL SELECT 'directive', 'D' || p_partkey, p_name, 100.0 FROM part UNION ALL SELECT 'compliance', 'D' || p_partkey, 'C' || p_partkey, NULL FROM part""",
)
def s16_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    """All five kinds of blocks, with lines that belong to none and numbers that are none, made of parts."""
    c = lambda x, before="": F.concat(F.lit(before), F.col(x).cast("string"))
    body = [
        F.lit("HOURS 5"), c("p_partkey", "AIRFRAME N"), c("p_type", "TYPE "), c("p_size", "HOURS "), F.lit("TITLE of no airframe"), c("p_partkey", "COMPONENT C"), c("p_partkey", "TAIL N"), F.lit("INSTALLED-HOURS many"), F.lit("END"), F.lit("TAIL N0"),
        c("p_partkey", "LIFE-LIMIT P"), F.concat(c("p_size", "LIMIT-HOURS "), F.lit(".5")), c("p_partkey", "DIRECTIVE D"), c("p_name", "TITLE "), F.lit("INTERVAL-HOURS 100"), F.lit("END"), F.concat(c("p_partkey", "COMPLIANCE D"), c("p_partkey", "  C")), F.lit("METHOD test"),
    ]
    got = formats.maintenance(table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.posexplode(F.array(*body)).alias("n", "line")))
    none = F.lit(None)
    row = lambda kind, id_, a, x: got[kind].select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), (F.col(a) if a else none.cast("string")).alias("a"), (F.col(x) if x else none.cast("double")).alias("x"))
    parts = [row("airframe", "tail_number", "type_designation", "total_hours"), row("component", "component_id", "tail_number", "installed_hours"), row("life-limit", "part_number", None, "limit_hours"), row("directive", "directive_id", "title", "interval_hours"), row("compliance", "directive_id", "component_id", None)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


MODEL = "p_name || '-' || CASE p_partkey % 5 WHEN 0 THEN p_size || 'x7b' WHEN 1 THEN p_size || 'b-a3b' WHEN 2 THEN p_size || '.5B coder' WHEN 3 THEN 'thinking ' || p_size || 'b' ELSE 'embedder' END"


@query(
    "p15_model_catalogue",
    f"""WITH m AS (SELECT p_partkey, lower({MODEL}) AS s, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 1000 END AS price, p_partkey % 5 AS k, p_size::DOUBLE AS n FROM part), b AS (SELECT *, CASE k WHEN 0 THEN n * 7 WHEN 1 THEN n WHEN 2 THEN n + 0.5 WHEN 3 THEN n END AS size FROM m WHERE k <> 4)
    SELECT p_partkey, size, CASE WHEN price IS NOT NULL THEN CASE WHEN price <= 0.2 THEN '$' WHEN price <= 0.6 THEN '$$' WHEN price <= 1.5 THEN '$$$' ELSE '$$$$' END ELSE CASE WHEN size <= 8 THEN '$' WHEN size <= 34 THEN '$$' WHEN size <= 80 THEN '$$$' ELSE '$$$$' END END AS tier,
    CASE WHEN size <= 8 THEN 's' WHEN size <= 34 THEN 'm' WHEN size <= 80 THEN 'l' ELSE 'xl' END AS bucket, CASE k WHEN 2 THEN 'coder' WHEN 3 THEN 'reasoning' ELSE 'general' END AS role FROM b""",
)
def p15_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue of models: what is no text model goes; size, cost tier, bucket and role by name and price."""
    part = table(spark, sf, "part").select("p_partkey", F.expr(MODEL).alias("model"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") / 1000).alias("price"))
    kept = part.where(~catalogue.excluded(F.col("model"))).withColumn("size", catalogue.billions(F.col("model")))
    return kept.select("p_partkey", "size", catalogue.cost_tier(F.col("price"), F.col("size")).alias("tier"), catalogue.size_bucket(F.col("size")).alias("bucket"), catalogue.role(F.col("model")).alias("role"))


CATALOGUE, OVERLAY = ("widget", "cold widget", "blue rod", "rod"), ("large", "PROMO")


@query(
    "s09_term_catalogue",
    r"SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(x) for x in regexp_extract_all(p_name || ' ' || p_type, '(?i)\b(cold widget|blue rod|widget|large|promo|rod)\b')])), ',') AS terms FROM part",
)
def s09(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a catalogue and its overlay, phrases before the words in them."""
    pattern = catalogue.term_pattern(CATALOGUE, OVERLAY)
    return table(spark, sf, "part").select("p_partkey", F.array_join(catalogue.term_hits(F.concat_ws(" ", "p_name", "p_type"), pattern), ",").alias("terms"))


@query("e01_arms", "SELECT page_id, 'source' AS arm, sha256(html) AS sha256 FROM pages UNION ALL SELECT page_id, 'reverse-text', sha256(reverse(html)) FROM pages")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as the arms of an experiment show them."""
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    return registry.arms(pages, ["source", "reverse-text"], "page_id", "tsx", KEY).select("page_id", "arm", F.sha2("output", 256).alias("sha256"))


@query("e02_literal_rows")
def e02(spark: SparkSession, sf: str) -> DataFrame:
    """Literals of pages as rows of a table function, in SQL."""
    literals.register_functions(spark)
    return spark.sql("SELECT page_id, l.pos, l.start, l.end, l.quote FROM {pages}, LATERAL literals_of(html) AS l", pages=table(spark, sf, "pages"))
