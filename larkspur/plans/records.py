"""Queries over runs of transforms and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import code, registry, similarity
from larkspur.operators import joins, runs, updates
from larkspur.operators.associate import associate
from larkspur.sources import records
from larkspur.sources.tables import table

from .registry import query
from .text import counters_sql


def fenced_sql(reply: str) -> str:
    """(conv_id, turn, body, discarded, error) of replies made of conversations, as `code.fenced` has them."""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    plain = f"CASE WHEN NOT starts_with(s, '```') OR NOT contains(s, chr(10)) THEN s ELSE rtrim(regexp_replace(substr(s, strpos(s, chr(10)) + 1), '```$', ''), {ws}) END"
    return f"""WITH r AS (SELECT conv_id, turn, trim({reply}, {ws}) AS s FROM conversations), l AS (SELECT *, string_split(s, chr(10)) AS x FROM r),
    a AS (SELECT *, list_filter(range(1, len(x) + 1), lambda i: regexp_full_match(rtrim(x[i], {ws}), '```[^`]*')) AS fences FROM l),
    c AS (SELECT *, CASE WHEN len(fences) = 2 THEN fences[2] ELSE len(x) + 1 END AS z, len(fences) = 0 OR (fences[1] = 1 AND (len(fences) = 1 OR fences[2] = len(x))) AS kept, [p for p in x[1:fences[1] - 1] if trim(p, {ws}) <> ''] AS before FROM a),
    d AS (SELECT *, len(fences) > 2 OR len(before) > 3 OR len([p for p in before if NOT (len([w for w in regexp_split_to_array(trim(p, {ws}), '\\s+') if w <> '']) >= 3 AND regexp_matches(trim(p, {ws}), '[:.!]$') AND NOT regexp_matches(p, '[{{}};=]'))]) > 0 OR (len(fences) = 2 AND NOT regexp_full_match(rtrim(x[fences[2]], {ws}), '```')) AS refused,
      array_to_string(x[fences[1] + 1:z - 1], chr(10)) AS body FROM c)
    SELECT conv_id, turn, CASE WHEN kept THEN {plain} WHEN NOT refused THEN rtrim(CASE WHEN len(fences) = 1 THEN regexp_replace(body, '```$', '') ELSE body END, {ws}) END AS body,
    CASE WHEN kept THEN 0 WHEN refused THEN -1 ELSE (coalesce(list_sum([length(p) for p in x[1:fences[1] - 1]]), 0) + coalesce(list_sum([length(p) for p in x[z + 1:]]), 0))::BIGINT END AS discarded, CASE WHEN NOT kept AND refused THEN 'text outside a single fenced block' END AS error FROM d"""


@query("j09_required_join", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    """A join in which a missing partner is an error."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return records.required(lines, table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"]).select("l_orderkey", "l_linenumber", "p_name")


@query("j11_joined_and_skipped", "SELECT source, count(l.doc_id) AS joined, count(*) - count(l.doc_id) AS skipped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a join takes and how many it skips."""
    docs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("there").alias("joined"), F.count_if(F.col("there").isNull()).alias("skipped"))


@query("k01_pending_jobs", "SELECT d.doc_id, r.role FROM documents d CROSS JOIN (SELECT DISTINCT role FROM conversations) r WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id AND c.role = r.role)")
def k01(spark: SparkSession, sf: str) -> DataFrame:
    """Items times modes without a result yet."""
    talks = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "role")
    jobs = joins.with_each(table(spark, sf, "documents").select("doc_id"), talks, "role")
    return records.pending(jobs, talks, ["doc_id", "role"])


@query(
    "j17_rewritten_paths",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^?#]*') AS path FROM pages), roots AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+(/[a-z]+)?') AS root FROM pages),
    b AS (SELECT page_id, path, (SELECT root FROM roots WHERE path = root OR starts_with(path, root || '/') ORDER BY length(root) DESC LIMIT 1) AS root FROM u) SELECT page_id, 'r' || substr(sha256(root), 1, 8) || substr(path, length(root) + 1) AS path FROM b""",
)
def j17(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with their longest known prefix replaced by its new name."""
    pages = table(spark, sf, "pages")
    paths = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^?#]*", 0).alias("path"))
    roots = pages.select(F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[a-z]+)?", 0).alias("root"))
    got = joins.longest_prefix(paths, "path", roots, "root")
    return got.select("page_id", F.concat(F.lit("r"), F.substring(F.sha2("root", 256), 1, 8), F.substr(F.col("path"), F.length("root") + 1)).alias("path"))


@query("t17_module_names", """WITH m AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([a-z]+)"', 1))) AS name FROM pages) SELECT page_id, count(*) AS modules, min(name) AS first FROM m WHERE length(name) >= 4 AND name NOT IN ('that', 'what', 'thing', 'tion') GROUP BY page_id""")
def t17_links(spark: SparkSession, sf: str) -> DataFrame:
    """Names that a page links to: short and general ones are left out."""
    names = F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([a-z]+)"'), F.lit(1)))
    own = F.array_except(F.filter(names, lambda x: F.length(x) >= 4), F.array(*map(F.lit, ("that", "what", "thing", "tion"))))
    got = table(spark, sf, "pages").select("page_id", own.alias("own")).where(F.size("own") > 0)
    return got.select("page_id", F.size("own").cast("long").alias("modules"), F.array_min("own").alias("first"))


@query("t21_fenced_block", fenced_sql("'Here it is:' || chr(10) || '```go' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'"))
def t21(spark: SparkSession, sf: str) -> DataFrame:
    """The one fenced block of a reply after a line of prose; texts with fences of their own are refused."""
    wrapped = F.concat(F.lit("Here it is:\n```go\n"), "text", F.lit("\n```\nDone."))
    return table(spark, sf, "conversations").select("conv_id", "turn", code.fenced(wrapped).alias("r")).select("conv_id", "turn", "r.body", F.coalesce("r.discarded", F.when(F.col("r").isNotNull(), -1)).alias("discarded"), "r.error")


@query("t24_blind_profile", r"""SELECT doc_id, 'lines ' || (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END) || ', bytes ' || strlen(text) || ', marks ' || len(regexp_extract_all(text, '[.,;:!?]')) AS stub, true AS content_free FROM documents""")
def t24_text(spark: SparkSession, sf: str) -> DataFrame:
    """A profile rendered as text, which holds no word of its source but the template's."""
    text = F.col("text")
    stub = F.format_string("lines %d, bytes %d, marks %d", code.line_count(text), F.octet_length(text), F.regexp_count(text, F.lit("[.,;:!?]")))
    words = F.regexp_extract_all("stub", F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", stub.alias("stub")).withColumn("content_free", F.size(F.array_except(words, F.array(*map(F.lit, ("lines", "bytes", "marks"))))) == 0)


LINES = "SELECT DISTINCT {id}, trim(x) AS line FROM (SELECT {id}, unnest(string_split(text, chr(10))) AS x FROM {t}) WHERE length(trim(x)) >= 8"


@query("t29_verbatim_lines", f"WITH d AS ({LINES.format(id='doc_id', t='documents')}), b AS (SELECT DISTINCT line FROM ({LINES.format(id='item_id', t='benchmark')})) SELECT doc_id, count(*) AS lines, count(b.line) AS verbatim, round(count(b.line) / count(*)::DOUBLE, 9) AS share FROM d LEFT JOIN b USING (line) GROUP BY doc_id")
def t29(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each text that occur in a benchmark passage as they are."""
    lines = lambda df, i: df.select(i, F.explode(F.split("text", "\n")).alias("x")).select(i, F.trim("x").alias("line")).where(F.length("line") >= 8).distinct()
    known = lines(table(spark, sf, "benchmark"), "item_id").select("line").distinct().withColumn("there", F.lit(1))
    got = lines(table(spark, sf, "documents"), "doc_id").join(known, "line", "left").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("there").alias("verbatim"))
    return got.withColumn("share", F.round(F.col("verbatim") / F.col("lines"), 9))


@query("t34_batch_run", "SELECT doc_id, sha256(reverse(text)) AS output_sha256, strlen(reverse(text))::BIGINT - strlen(text)::BIGINT AS bytes_delta, (CASE WHEN ends_with(text, chr(10)) AND NOT starts_with(text, chr(10)) THEN 1 WHEN starts_with(text, chr(10)) AND NOT ends_with(text, chr(10)) THEN -1 ELSE 0 END)::BIGINT AS lines_delta FROM documents")
def t34(spark: SparkSession, sf: str) -> DataFrame:
    """Every text through one transform: the output's hash, and counters before and after."""
    got = registry.transform(table(spark, sf, "documents").select("doc_id", "text"), "reverse-text")
    lines = code.line_count(F.col("output")) - code.line_count(F.col("text"))
    return got.select("doc_id", F.sha2("output", 256).alias("output_sha256"), (F.octet_length("output") - F.octet_length("text")).cast("long").alias("bytes_delta"), lines.cast("long").alias("lines_delta"))


@query("t35_acceptance", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'no output' WHEN regexp_matches(text, '(?i)\\b(thinking|trash)\\b') THEN 'reasoning' WHEN NOT regexp_matches(text, '[.!]\\s*$') THEN 'does not parse' WHEN n_chars < 500 THEN 'low score' ELSE 'accepted' END AS outcome FROM documents")
def t35(spark: SparkSession, sf: str) -> DataFrame:
    """The first rung of a ladder of checks that a text fails."""
    outcome = F.when(F.coalesce("text", F.lit("")) == "", "no output").when(F.col("text").rlike(r"(?i)\b(thinking|trash)\b"), "reasoning").when(~F.col("text").rlike(r"[.!]\s*\z"), "does not parse").when(F.col("n_chars") < 500, "low score").otherwise("accepted")
    return table(spark, sf, "documents").select("doc_id", outcome.alias("outcome"))


@query("a20_gate_states", "SELECT source, count(*) AS n, count(*) FILTER (n_chars % 4 = 0 OR doc_id % 5 = 0) AS any_off, count(*) FILTER (NOT (n_chars % 4 = 0 AND doc_id % 5 = 0)) AS not_all_off FROM documents GROUP BY source")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    """Records with any threshold off, and with not all of them."""
    s = F.struct((F.col("n_chars") % 4).alias("a"), (F.col("doc_id") % 5).alias("b"))
    docs = table(spark, sf, "documents").select("source", s.alias("s"))
    off = [F.col("s.a") == 0, F.col("s.b") == 0]
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.count_if(off[0] | off[1]).alias("any_off"), F.count_if(~(off[0] & off[1])).alias("not_all_off"))


@query("a23_score_summary", "SELECT lang, round(avg(n_chars), 6) AS mean, max(n_chars) AS most, count(*) FILTER (n_chars > 2000) AS over, round(avg(n_chars) FILTER (quality = 1), 6) AS mean_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def a23(spark: SparkSession, sf: str) -> DataFrame:
    """Means, of a subset too, the largest, and counts over a threshold."""
    joined = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") > 2000).alias("over"), F.round(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))), 6).alias("mean_good"))


@query(
    "t17_own_modules",
    f"""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1) || '/internal/db', '/') AS s FROM pages), c AS (SELECT page_id, s[2:least(3, list_position(s, 'internal') - 1)] AS c FROM p)
    SELECT page_id, array_to_string(list_sort(list_distinct([x for x in c if len(x) >= 4 AND NOT contains(x, '.') AND NOT list_contains([{', '.join(f"'{w}'" for w in code.GENERAL)}], lower(x))] || ['ledgerapp'])), ',') AS names FROM c""",
)
def t17(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that Go texts import from themselves; the texts are made of pages' addresses."""
    path = F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)
    text = F.concat(F.lit('package a\n\nimport (\n\t"fmt"\n\t"net/http"\n\t_ "'), path, F.lit('/internal/db"\n\tx "ledgerapp/store"\n\t"app/store"\n\t"example.org/other"\n)\n'))
    return table(spark, sf, "pages").select("page_id", F.array_join(code.own_modules(text), ",").alias("names"))


_REPLY = """CASE turn % 6 WHEN 0 THEN 'Here is it:' || chr(10) || '```go' || chr(10) || text || chr(10) || '```' WHEN 1 THEN 'Here it is.' || chr(10) || 'a = b;' || chr(10) || '```' || chr(10) || text || chr(10) || '```' WHEN 2 THEN text || chr(10) || 'no fence'
  WHEN 3 THEN '```' || chr(10) || text || '```' WHEN 4 THEN 'It is this one:' || chr(10) || chr(10) || '```ts' || chr(10) || text || chr(10) || '```' || chr(10) || 'And ' || role || '.' ELSE repeat('This is a line.' || chr(10), 4) || '```' || chr(10) || text END"""


@query("t21_fenced_reply", fenced_sql(_REPLY))
def t21_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with one fenced block behind prose, behind code, without a fence, open at the end, with a note behind it, and behind too much prose."""
    k, text = F.col("turn") % 6, F.col("text")
    wrap = lambda before, after: F.concat(F.lit(before), text, after)
    reply = F.when(k == 0, wrap("Here is it:\n```go\n", F.lit("\n```"))).when(k == 1, wrap("Here it is.\na = b;\n```\n", F.lit("\n```"))).when(k == 2, F.concat(text, F.lit("\nno fence")))
    reply = reply.when(k == 3, wrap("```\n", F.lit("```"))).when(k == 4, wrap("It is this one:\n\n```ts\n", F.concat(F.lit("\n```\nAnd "), "role", F.lit(".")))).otherwise(wrap("This is a line.\n" * 4 + "```\n", F.lit("")))
    return table(spark, sf, "conversations").select("conv_id", "turn", code.fenced(reply).alias("r")).select("conv_id", "turn", "r.body", F.coalesce("r.discarded", F.when(F.col("r").isNotNull(), -1)).alias("discarded"), "r.error")


@query(
    "t19_targets",
    f"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN ' a zoo of {{}} ' WHEN 2 THEN '  ' END AS free, CASE turn % 4 WHEN 1 THEN 'nowhere' WHEN 2 THEN 'chess-engine' WHEN 3 THEN role END AS chosen, (('0x' || substr(sha256(coalesce(text, '')), 1, 16))::UBIGINT % {len(code.TARGETS)})::BIGINT AS k FROM conversations)
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN {list(code.TARGETS.values())}[k + 1] WHEN 1 THEN 'a zoo of {{}}' WHEN 2 THEN '{code.TARGETS["chess-engine"]}' END AS domain, CASE turn % 4 WHEN 0 THEN {list(code.TARGETS)}[k + 1] WHEN 2 THEN 'chess-engine' END AS target_id,
    CASE turn % 4 WHEN 3 THEN 'ValueError' END AS error_code, CASE turn % 4 WHEN 3 THEN 'ValueError: unknown target: ' || chosen END AS error_detail FROM t""",
)
def t19(spark: SparkSession, sf: str) -> DataFrame:
    """The target of each turn: by its text, by a free description, by an id, and by an unknown id, which is the row's error."""
    k = F.col("turn") % 4
    talks = table(spark, sf, "conversations").withColumn("free", F.when(k == 1, " a zoo of {} ").when(k == 2, "  ")).withColumn("chosen", F.when(k == 1, "nowhere").when(k == 2, "chess-engine").when(k == 3, F.col("role")))
    got = runs.run_cases(talks, ["conv_id", "turn"], code.pick_target, ["text", "free", "chosen"], "domain string, target_id string")
    return got.select("conv_id", "turn", "domain", "target_id", F.col("error.code").alias("error_code"), F.col("error.detail").alias("error_detail"))


@query(
    "t34_isolated_runs",
    """SELECT conv_id, turn, CASE WHEN text IS NOT NULL AND NOT contains(lower(text), 'error') AND length(text) % 5 <> 0 THEN sha256(reverse(text)) END AS output_sha256, CASE WHEN text IS NULL THEN 'no input' WHEN contains(lower(text), 'error') THEN 'refused' WHEN length(text) % 5 = 0 THEN 'ZeroDivisionError' END AS error_code FROM conversations""",
)
def t34_isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn through a transform that refuses some texts and fails on others: each failure is a row."""

    class Refused(Exception):
        code = "refused"

    class Missing(Exception):
        code = "no input"

    def backwards(text: str | None) -> str:
        if text is None:
            raise Missing("a case needs a text")
        if "error" in text.lower():
            raise Refused("a text that speaks of errors")
        return text[::-1] if 1 / (len(text) % 5) else ""

    got = runs.run_cases(table(spark, sf, "conversations"), ["conv_id", "turn"], backwards, ["text"], "output string")
    return got.select("conv_id", "turn", F.sha2("output", 256).alias("output_sha256"), F.col("error.code").alias("error_code"))


_T = counters_sql("html", "ts")
_C = r"(?m)^\s*export\s+function\s+[A-Z]\w*\s*\("


@query(
    "t24_profile",
    f"""SELECT page_id, 'STRUCTURAL PROFILE' || chr(10) || 'language: tsx' || chr(10) || 'lines: ' || {_T["lines"]} || chr(10) || 'bytes: ' || {_T["bytes"]} || chr(10) || 'functions: ' || {_T["funcs"]} || chr(10) || 'components: ' || len(regexp_extract_all(html, '{_C}')) || chr(10)
    || 'classes: ' || {_T["structs"]} || chr(10) || 'types: ' || {_T["interfaces"]} || chr(10) || 'imports: ' || {_T["imports"]} || chr(10) || 'exports: ' || {_T["exports"]} || chr(10) || 'string literals: ' || {_T["string_literals"]} || chr(10) || 'max brace depth: ' || {_T["max_brace_depth"]} || chr(10) AS stub, 0 AS foreign_words FROM pages""",
)
def t24(spark: SparkSession, sf: str) -> DataFrame:
    """The profile of each page, which holds no word that its template hasn't got."""
    got = table(spark, sf, "pages").select("page_id", code.profile(F.col("html"), "tsx").alias("stub"))
    return got.withColumn("foreign_words", F.size(code.foreign_words(F.col("stub"))))


@query("t29_scores")
def t29_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn scored against the one before: lines, vocabulary, spans, shape and leak terms."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = table(spark, sf, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before is not null")
    return pairs.select("conv_id", "turn", similarity.scores(F.col("before"), F.col("text"), ("section", "general", "system")).alias("s")).select("conv_id", "turn", "s.*").withColumns({c: F.to_json(F.array_sort(F.map_entries(c))) for c in ("leak_terms", "shape_loss")})


_B, _A = counters_sql("html", "ts"), counters_sql("reverse(html)", "ts")


@query("t34_batch_counters", f"SELECT page_id, sha256(reverse(html)) AS output_sha256, {', '.join(f'{_A[c]} AS after_{c}, {_A[c]} - {_B[c]} AS delta_{c}' for c in code.COUNTER_NAMES)}, NULL AS error FROM pages")
def t34_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Every page through one transform, with all counters."""
    got = registry.batch(table(spark, sf, "pages").select("page_id", F.col("html").alias("text")), "reverse-text", "ts")
    return got.select("page_id", "output_sha256", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in code.COUNTER_NAMES for s in ("after", "delta")], "error")


@query(
    "u06_associated",
    """WITH e AS (SELECT o_custkey AS request, list_sort(list(o_orderkey)) AS ids, count(DISTINCT o_orderstatus) AS stations FROM orders GROUP BY o_custkey)
    SELECT request, CASE WHEN len(ids) < 2 THEN 'at least two detections are required' WHEN request % 5 = 0 THEN 'origin time must be RFC 3339' WHEN stations < 2 THEN 'detections must span two stations' END AS reason FROM e""",
)
def u06(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders as detections that are made one event each, and why some are not."""
    orders = table(spark, sf, "orders")
    detections = orders.select(F.col("o_orderkey").alias("detection_id"), F.lit("Z").alias("channel_id"), F.col("o_orderstatus").alias("station_id"), F.col("o_totalprice").alias("amplitude"), F.lit(None).cast("string").alias("event_id"))
    stations = orders.select(F.col("o_orderstatus").alias("station_id")).distinct().select("station_id", F.ascii("station_id").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"))
    time = F.when(F.col("request") % 5 == 0, "2024-01-01").otherwise("2024-01-01T00:00:00Z")
    requests = orders.groupBy(F.col("o_custkey").alias("request")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("detection_ids"))
    requests = requests.select("request", time.alias("origin_time"), F.lit(60.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(5.0).alias("depth_km"), "detection_ids")
    got = associate(requests, detections, stations, 0)
    return requests.select("request").join(got.refused, "request", "left")


@query(
    "u06_magnitudes",
    """WITH e AS (SELECT o_custkey AS request, count(*) AS n, count(DISTINCT o_orderstatus) AS stations FROM orders GROUP BY o_custkey HAVING count(*) >= 2 AND count(DISTINCT o_orderstatus) >= 2),
    i AS (SELECT request, 'EVT-' || lpad(row_number() OVER (ORDER BY request)::VARCHAR, 6, '0') AS event_id, n FROM e), d AS (SELECT event_id, o_totalprice, power(sin(radians(ascii(o_orderstatus) - 60) / 2), 2) AS a, n FROM orders JOIN i ON request = o_custkey)
    SELECT event_id, n AS detection_count, round(avg(log10(o_totalprice) + 3 * log10(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a))) - 2.92), 6) AS magnitude FROM d GROUP BY ALL""",
)
def u06_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    """The events that associations make, with the mean of their estimates."""
    orders = table(spark, sf, "orders")
    detections = orders.select(F.col("o_orderkey").alias("detection_id"), F.lit("Z").alias("channel_id"), F.col("o_orderstatus").alias("station_id"), F.col("o_totalprice").alias("amplitude"), F.lit(None).cast("string").alias("event_id"))
    stations = orders.select(F.col("o_orderstatus").alias("station_id")).distinct().select("station_id", F.ascii("station_id").cast("double").alias("latitude"), F.lit(1.0).alias("longitude"))
    requests = orders.groupBy(F.col("o_custkey").alias("request")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("detection_ids"))
    requests = requests.select("request", F.lit("2024-01-01T00:00:00Z").alias("origin_time"), F.lit(60.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(5.0).alias("depth_km"), "detection_ids")
    return associate(requests, detections, stations, 0).events.select("event_id", "detection_count", F.round("magnitude", 6).alias("magnitude"))


@query("j10_judged_records", "SELECT c.conv_id || '|' || c.turn || '|judge' AS reply_id, c.conv_id || '|' || c.turn AS item_id, role FROM conversations c WHERE turn % 2 = 0")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    """Replies joined with the record whose id theirs begins with."""
    item = F.concat_ws("|", "conv_id", "turn")
    talks = table(spark, sf, "conversations")
    replies = talks.select(F.concat(item, F.lit("|judge")).alias("reply_id"))
    records_ = talks.where("turn % 2 = 0").select(item.alias("item_id"), "role")
    return joins.by_item_prefix(replies, records_, "reply_id", "item_id").select("reply_id", "item_id", "role")


@query("k03_drift", "SELECT 'customer ' || c_custkey AS key, c_mktsegment AS was, CASE WHEN c_custkey % 7 <> 2 THEN CASE WHEN c_custkey % 7 = 1 THEN 'OTHER' ELSE c_mktsegment END END AS \"is\" FROM customer WHERE c_custkey % 7 IN (1, 2)")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    """Settings that a resumed run has otherwise than the first."""
    customers, k = table(spark, sf, "customer"), F.col("c_custkey") % 7
    was = customers.select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    now = customers.where(k != 2).select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("key"), F.when(k == 1, "OTHER").otherwise(F.col("c_mktsegment")).alias("value"))
    return updates.drift(was, now)
