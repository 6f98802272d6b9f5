"""Relational queries: searches, joins, aggregates, latest prior rows, tiers, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import joins, search, tiers, updates
from larkspur.sources.tables import table

from .registry import query

DAY = "cast(o_orderdate AS date)"


@query("p01_search_parts", "SELECT p_partkey, p_name, p_brand FROM part WHERE upper(p_name) LIKE '%RING%' AND p_brand = 'Brand#2' ORDER BY p_name NULLS FIRST, p_partkey LIMIT 50")
def p01(spark: SparkSession, sf: str) -> DataFrame:
    """Substring and equality filters, first page in order."""
    got = search.search(table(spark, sf, "part"), equal={"p_brand": "Brand#2"}, contains={"p_name": "ring"})
    return search.page(got.select("p_partkey", "p_name", "p_brand"), F.asc_nulls_first("p_name"), "p_partkey")


@query("p02_search_orders_by_date", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-03-01' AND '1996-04-15'")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    """Equality and an inclusive window of ISO dates."""
    orders = search.search(table(spark, sf, "orders"), equal={"o_orderstatus": "F"})
    return search.within_days(orders, "o_orderdate", "1996-03-01", "1996-04-15").select("o_orderkey", "o_custkey", "o_totalprice")


@query("p03_box_events", "SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND coalesce(value, 0) BETWEEN 5 AND 50 AND user_id BETWEEN 10 AND 60")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    """All bounds of a box, nulls as 0."""
    day = lambda d: F.lit(d).cast("timestamp")
    return search.box(table(spark, sf, "events"), {"ts": (day("2024-01-05"), day("2024-01-20")), "value": (5, 50), "user_id": (10, 60)}, {"value": 0}).select("event_id", "user_id", "value")


@query("p04_search_customers", "SELECT c_custkey, c_name FROM customer WHERE upper(c_name) LIKE '%00012%' AND c_mktsegment = 'BUILDING'")
def p04(spark: SparkSession, sf: str) -> DataFrame:
    """Component search: equality and substring."""
    return search.search(table(spark, sf, "customer"), equal={"c_mktsegment": "BUILDING", "c_nationkey": None}, contains={"c_name": "00012"}).select("c_custkey", "c_name")


@query("p05_null_defaults", "SELECT doc_id, coalesce(nullif(lang, 'fr'), '') AS lang, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    """Null to default, and a null test as a boolean."""
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", F.coalesce(F.nullif("lang", F.lit("fr")), F.lit("")).alias("lang"), F.col("quality").isNotNull().alias("labelled"))


@query("p07_children_or_missing", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    """Parents with and without children are told apart from absent parents."""
    parents, orders = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = parents.join(orders, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True))
    return have.union(parents.join(orders, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("p16_point_lookup", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey = 7")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    """One row by key."""
    return search.found(table(spark, sf, "supplier"), s_suppkey=7).select("s_suppkey", "s_name", "s_acctbal")


@query(
    "p17_ordered_children",
    """SELECT o_orderkey, array_to_string(list(format('{}:{}:{}', l_linenumber, l_partkey, l_suppkey) ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_orderkey IS NOT NULL), ',') AS lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def p17(spark: SparkSession, sf: str) -> DataFrame:
    """Each parent with its ordered children."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    got = search.children(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], [], "lines")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ",")
    return got.select("o_orderkey", F.when(F.size("lines") > 0, text).alias("lines"))


@query("p19_code_mapping", "SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN '' WHEN lang = 'en' THEN 'eng' WHEN lang = 'es' THEN 'spa' WHEN lang = 'fr' THEN 'fre' ELSE 'mul' END AS code FROM documents")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    """Codes mapped with a fallback."""
    return table(spark, sf, "documents").select("doc_id", search.mapped(F.col("lang"), {"en": "eng", "es": "spa", "fr": "fre"}, "", "mul").alias("code"))


@query("p20_validated", "SELECT event_type, event_type IN ('click', 'view', 'purchase') AS allowed, regexp_matches(props, '^\\{\"k\": [0-9]+\\}$') AS well_formed, count(*) AS n FROM events GROUP BY ALL")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    """Allow-lists and patterns."""
    events = table(spark, sf, "events").select("event_type", F.col("event_type").isin("click", "view", "purchase").alias("allowed"), F.col("props").rlike(r'^\{"k": [0-9]+\}\z').alias("well_formed"))
    return events.groupBy("event_type", "allowed", "well_formed").agg(F.count("*").alias("n"))


@query("j01_two_tables", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    """Inner join of two tables."""
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("j02_three_tables", "SELECT l_orderkey, l_linenumber, c_name, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 45")
def j02(spark: SparkSession, sf: str) -> DataFrame:
    """Inner join of three tables."""
    lines, orders, customers = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.where("l_quantity > 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("l_orderkey", "l_linenumber", "c_name", "o_totalprice")


@query("j03_four_tables", "SELECT l_orderkey, l_linenumber, p_name, s_name, o_orderstatus FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 10")
def j03(spark: SparkSession, sf: str) -> DataFrame:
    """A star join of four tables."""
    lines, part, supplier, orders = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "orders"))
    joined = lines.join(part.where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "p_name", "s_name", "o_orderstatus")


@query(
    "j04_inner_and_left",
    """SELECT d.doc_id, d.source, CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL WHEN coalesce(quality, 0) * 2 >= coalesce(toxic, 0) * 3 THEN 'quality' ELSE 'toxic' END AS governs, quality
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def j04(spark: SparkSession, sf: str) -> DataFrame:
    """Left join and the argument of a maximum whose earlier argument wins ties."""
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    q, t = F.coalesce("quality", F.lit(0)) * 2, F.coalesce("toxic", F.lit(0)) * 3
    governs = F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).when(q >= t, "quality").otherwise("toxic")
    return joined.select("doc_id", "source", governs.alias("governs"), "quality")


@query("j05_left_count", "SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    """Children counted for every parent; those without any have 0."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("j06_join_order_limit", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def j06(spark: SparkSession, sf: str) -> DataFrame:
    """A join and its top rows."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("o_orderkey", "c_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query(
    "j07_first_match",
    """WITH best AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h, min(event_id) AS m FROM events WHERE value >= 20 GROUP BY ALL)
    SELECT e.event_id, m AS matched_id, CASE WHEN m IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status
    FROM events e LEFT JOIN best b ON e.user_id = b.user_id AND e.event_type = b.event_type AND date_trunc('hour', e.ts) = b.h WHERE e.value < 20""",
)
def j07(spark: SparkSession, sf: str) -> DataFrame:
    """Claims matched on all keys, first match wins, unmatched ones stay."""
    events = table(spark, sf, "events").withColumn("h", F.date_trunc("hour", "ts"))
    got = joins.first_match(events.where("value < 20"), events.where("value >= 20"), ["user_id", "event_type", "h"], "event_id")
    return got.select("event_id", "matched_id", "match_status")


@query(
    "j08_latest_prior",
    f"""WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {DAY} AS day FROM orders)
    SELECT x.o_orderkey, (SELECT y.o_orderkey FROM t y WHERE y.o_custkey = x.o_custkey AND y.day < x.day AND y.o_orderstatus <> 'P' ORDER BY y.day DESC, y.o_orderkey DESC LIMIT 1) AS prior_key FROM t x""",
)
def j08(spark: SparkSession, sf: str) -> DataFrame:
    """The customer's latest trusted order of an earlier day."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    got = joins.latest_prior(orders, "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")), F.col("o_orderstatus") != "P", ["o_orderkey"])
    return got.select("o_orderkey", F.col("prior.o_orderkey").alias("prior_key"))


@query(
    "j13_coverage",
    """WITH want AS (SELECT s.source, e.doc_id, r.role FROM (SELECT DISTINCT source FROM documents) s JOIN documents e USING (source) CROSS JOIN (SELECT DISTINCT role FROM conversations) r),
    seen AS (SELECT conv_id, role, bool_or(length(text) > 200) AS ok FROM conversations GROUP BY ALL)
    SELECT source, want.role, count(*) AS expected, count(*) FILTER (ok IS NULL) AS absent, count(*) FILTER (NOT ok) AS missing, count(*) FILTER (ok) AS present
    FROM want LEFT JOIN seen ON want.doc_id = seen.conv_id AND want.role = seen.role GROUP BY source, want.role""",
)
def j13(spark: SparkSession, sf: str) -> DataFrame:
    """Expected rows of every item and mode against those that are there."""
    talks = table(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")
    expected = joins.with_each(table(spark, sf, "documents").select("source", "doc_id"), talks, "role")
    return joins.coverage(expected, talks, ["doc_id", "role"], ["source", "role"], F.length("text") > 200)


@query(
    "s10_longest_prefix",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^?#]*') AS path FROM pages),
    roots AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+(/[a-z]+)?') AS root FROM pages)
    SELECT page_id, (SELECT root FROM roots WHERE path = root OR starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM u""",
)
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest ancestor of each path among known roots."""
    pages = table(spark, sf, "pages")
    paths = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^?#]*", 0).alias("path"))
    roots = pages.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[a-z]+)?", 0).alias("root"))
    return joins.longest_prefix(paths, "path", roots, "root").select("page_id", "root")


@query("a01_ready", "SELECT count(*) AS n FROM orders")
def a01(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a table."""
    return table(spark, sf, "orders").agg(F.count("*").alias("n"))


@query(
    "a02_rollup",
    """SELECT l_suppkey, coalesce(sum(cast(l_quantity AS BIGINT)), 0)::BIGINT AS units, count(*) AS n, coalesce(sum(datediff('day', o_orderdate, l_shipdate)), 0)::BIGINT AS lag_days,
    CASE WHEN count(*) > 0 THEN 100.0 * (count(*) * 480 - sum(cast(l_quantity AS BIGINT))) / (count(*) * 480) ELSE 0 END AS uptime
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY l_suppkey""",
)
def a02(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and a derived percentage over a range of dates."""
    orders = table(spark, sf, "orders").where("o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'").select("o_orderkey", "o_orderdate")
    joined = table(spark, sf, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    units, n = F.sum(F.col("l_quantity").cast("long")), F.count("*")
    return joined.groupBy("l_suppkey").agg(
        F.coalesce(units, F.lit(0)).alias("units"),
        n.alias("n"),
        F.coalesce(F.sum(F.datediff("l_shipdate", "o_orderdate")), F.lit(0)).alias("lag_days"),
        F.when(n > 0, F.lit(100.0) * (n * 480 - units) / (n * 480)).otherwise(0.0).alias("uptime"),
    )


@query("a03_progress", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and distinct counts by two keys."""
    return table(spark, sf, "lineitem").where("l_shipdate is not null").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("a04_summary", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE value > 50) AS large FROM events")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    """Several distinct counts and a conditional one."""
    return table(spark, sf, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("kinds"), F.count_if(F.col("value") > 50).alias("large"))


@query(
    "a05_assembled_totals",
    """SELECT o_orderkey, round(coalesce(sum(l_extendedprice), 0), 2) AS total, count(l_orderkey) AS n_lines, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def a05(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a parent from its children."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("s"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("f")
    )
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"), F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("f", F.lit("")).alias("flags"))


@query("a06_average_magnitude", "SELECT user_id, round(avg(log10(greatest(value, 0.1))), 6) AS magnitude, count(DISTINCT event_type) AS stations FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 2")
def a06(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of estimates where two sources or more agree."""
    got = table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg(F.log10(F.greatest("value", F.lit(0.1)))), 6).alias("magnitude"), F.countDistinct("event_type").alias("stations"))
    return got.where("stations >= 2")


@query(
    "a34_best_per_group",
    "SELECT p_brand, p_type, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey, max(p_retailprice) AS price FROM part GROUP BY p_brand, p_type",
)
def a34(spark: SparkSession, sf: str) -> DataFrame:
    """The best row of each group; ties go to the smaller key."""
    best = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("minus"))).alias("b"))
    return best.select("p_brand", "p_type", (-F.col("b.minus")).alias("p_partkey"), F.col("b.p_retailprice").alias("price"))


@query(
    "w02_tiered_charge",
    """WITH used AS (SELECT c_custkey, cast(coalesce(sum(l_quantity), 0) AS BIGINT) - 40 AS u FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey)
    SELECT c_custkey, u AS used, (greatest(least(u, 100), 0) * 12 + greatest(least(u, 500) - 100, 0) * 9 + greatest(u - 500, 0) * 7)::BIGINT AS cents FROM used""",
)
def w02(spark: SparkSession, sf: str) -> DataFrame:
    """A charge in tiers, the last one open."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    used = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("l_quantity").alias("q"))
    rates = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(top).cast("long").alias("upper"), F.lit(rate).cast("long").alias("rate")) for n, top, rate in ((1, 100, 12), (2, 500, 9), (3, None, 7))])
    u = (F.coalesce("q", F.lit(0.0)).cast("long") - 40).alias("used")
    return table(spark, sf, "customer").select("c_custkey").join(used, "c_custkey", "left").select("c_custkey", u).withColumn("cents", tiers.tiered_charge(F.col("used"), rates))


@query("w03_queue_position", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def w03(spark: SparkSession, sf: str) -> DataFrame:
    """A row's place in its record, from 1."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("position"))


@query("w04_minted_ids", "SELECT o_orderkey, format('ord{:07d}', row_number() OVER (ORDER BY o_orderkey)) AS minted FROM orders")
def w04(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential ids in the order of a key."""
    return updates.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1_000_000, "ord%07d", "minted")


@query("o02_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def o02(spark: SparkSession, sf: str) -> DataFrame:
    """A later page, newest first."""
    return search.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.desc("o_orderdate"), "o_orderkey", limit="500", offset=100)


@query("o03_two_descending", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_shipdate DESC NULLS LAST, l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def o03(spark: SparkSession, sf: str) -> DataFrame:
    """Top rows by two descending keys, with a tie-break."""
    lines = table(spark, sf, "lineitem").orderBy(F.desc("l_shipdate"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(25)
    return lines.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("o04_boolean_then_number", "SELECT s_suppkey, s_acctbal >= 0 AS solvent, s_acctbal FROM supplier ORDER BY solvent DESC, s_acctbal, s_suppkey LIMIT 30")
def o04(spark: SparkSession, sf: str) -> DataFrame:
    """Top rows by a boolean, then a number."""
    return table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") >= 0).alias("solvent"), "s_acctbal").orderBy(F.desc("solvent"), "s_acctbal", "s_suppkey").limit(30)


@query(
    "o05_mapped_rank",
    "SELECT p_partkey, p_type, p_name FROM part ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END, lower(p_name), p_partkey LIMIT 40",
)
def o05(spark: SparkSession, sf: str) -> DataFrame:
    """Top rows by a mapped rank and a lower-cased name."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("ECONOMY", 0, "STANDARD", 1, "PROMO", 2)]), F.col("p_type")), F.lit(3))
    return table(spark, sf, "part").select("p_partkey", "p_type", "p_name").orderBy(rank, F.lower("p_name"), "p_partkey").limit(40)


@query(
    "u01_insert_or_ignore",
    """WITH fresh AS (SELECT o_custkey AS k, arg_min('order ' || o_orderkey, o_orderkey) AS name FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT k, name FROM fresh WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""",
)
def u01(spark: SparkSession, sf: str) -> DataFrame:
    """First new row of a key is inserted, known keys are left alone."""
    base = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), "o_orderkey")
    return updates.insert_or_ignore(base, rows, ["k"], "o_orderkey")


@query(
    "u02_insert_or_replace",
    """WITH fresh AS (SELECT o_custkey AS k, arg_max('order ' || o_orderkey, o_orderkey) AS name FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT k FROM fresh) UNION ALL SELECT k, name FROM fresh""",
)
def u02(spark: SparkSession, sf: str) -> DataFrame:
    """The last new row of a key takes the place of the old one."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), "o_orderkey")
    return updates.insert_or_replace(base, rows, ["k"], "o_orderkey")


PATCHES = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'X' END AS o_orderstatus, o_orderkey % 5 <> 0 AS has_o_orderstatus FROM orders WHERE o_orderkey % 2 = 0"""


@query(
    "u03_patch",
    f"""WITH c AS ({PATCHES})
    SELECT o.o_orderkey, CASE WHEN has_o_orderstatus AND (c.o_orderstatus IS NULL OR c.o_orderstatus IN ('F', 'O', 'P')) THEN c.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus FROM orders o LEFT JOIN c USING (o_orderkey)""",
)
def u03(spark: SparkSession, sf: str) -> DataFrame:
    """Partial updates: absent differs from null, and bad changes are rejected."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    changes = orders.where(k % 2 == 0).select(k, F.when(k % 3 == 0, "F").when(k % 3 == 1, "X").alias("o_orderstatus"), (k % 5 != 0).alias("has_o_orderstatus"))
    rules = {"bad status": ~F.col("has_o_orderstatus") | F.col("new_o_orderstatus").isin("F", "O", "P")}
    return updates.patch(orders, changes, "o_orderkey", ["o_orderstatus"], rules)[0]


@query(
    "u03_rejected",
    f"SELECT o_orderkey, 'bad status' AS reason FROM ({PATCHES}) WHERE has_o_orderstatus AND o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O', 'P')",
)
def u03_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that a rule rejects."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    changes = orders.where(k % 2 == 0).select(k, F.when(k % 3 == 0, "F").when(k % 3 == 1, "X").alias("o_orderstatus"), (k % 5 != 0).alias("has_o_orderstatus"))
    rules = {"bad status": ~F.col("has_o_orderstatus") | F.col("new_o_orderstatus").isin("F", "O", "P")}
    return updates.patch(orders, changes, "o_orderkey", ["o_orderstatus"], rules)[1]


@query(
    "u04_set_once",
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1990-01-01' END AS confirmed FROM customer), v AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY o_custkey)
    SELECT c_custkey, coalesce(confirmed, d) AS confirmed FROM t LEFT JOIN v ON o_custkey = c_custkey""",
)
def u04(spark: SparkSession, sf: str) -> DataFrame:
    """A column that is set where it is null, and never again."""
    base = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("1990-01-01").cast("timestamp_ntz")).alias("confirmed"))
    values = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("confirmed"))
    return updates.set_once(base, values, "c_custkey", "confirmed")


@query(
    "u05_requeue",
    "SELECT o_orderkey::VARCHAR AS id, o_totalprice FROM orders UNION ALL SELECT o_orderkey || '-RQ', 0 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000",
)
def u05(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and copies of some of them with a suffix and value 0."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice", "o_orderstatus")
    again = orders.where("o_orderstatus = 'P' and o_totalprice > 400000").select(F.concat("id", F.lit("-RQ")).alias("id"), F.lit(0.0).alias("o_totalprice"))
    return orders.select("id", "o_totalprice").union(again)


@query("k02_current_attempt", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    """The latest attempt of each key."""
    return updates.current(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(
    "k09_nested_export",
    """SELECT c_custkey, '{"id":' || c_custkey || ',"loans":[' || coalesce(string_agg('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey), '') || ']}' AS doc
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def k09(spark: SparkSession, sf: str) -> DataFrame:
    """Nested documents as JSON with a stable order."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    got = search.children(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", ["key", "status"], [], "loans")
    return got.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), "loans")).alias("doc"))
