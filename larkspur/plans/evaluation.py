"""Evaluation queries. Records are simulated by the tables: an arm is a source, an attacker a language, a source file a
document's id mod 30, a correct answer the quality label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import stats
from larkspur.operators import evaluation as ev
from larkspur.operators import joins
from larkspur.sources.tables import table

from .registry import query

RECORDS = "SELECT d.doc_id, source AS arm, lang AS attacker, d.doc_id % 30 AS file, quality AS correct, (d.doc_id % 100) / 100.0 AS confidence FROM documents d JOIN labels USING (doc_id)"
R = f"WITH r AS ({RECORDS}) "
WILSON = """sum(correct) / count(*)::DOUBLE AS rate,
  greatest(0, (sum(correct) / count(*)::DOUBLE + 3.8414588206941254 / (2 * count(*))) / (1 + 3.8414588206941254 / count(*)) - 1.959963984540054 * sqrt(sum(correct) / count(*)::DOUBLE * (1 - sum(correct) / count(*)::DOUBLE) / count(*) + 3.8414588206941254 / (4.0 * count(*) * count(*))) / (1 + 3.8414588206941254 / count(*))) AS low,
  least(1, (sum(correct) / count(*)::DOUBLE + 3.8414588206941254 / (2 * count(*))) / (1 + 3.8414588206941254 / count(*)) + 1.959963984540054 * sqrt(sum(correct) / count(*)::DOUBLE * (1 - sum(correct) / count(*)::DOUBLE) / count(*) + 3.8414588206941254 / (4.0 * count(*) * count(*))) / (1 + 3.8414588206941254 / count(*))) AS high"""
ROUNDED = "round(rate, 9) AS rate, round(low, 9) AS low, round(high, 9) AS high"


def records(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("arm"), F.col("lang").alias("attacker"))
    joined = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("correct")), "doc_id")
    return joined.withColumn("file", F.col("doc_id") % 30).withColumn("confidence", (F.col("doc_id") % 100) / F.lit(100.0))


def with_wilson(df: DataFrame, *by: str) -> DataFrame:
    got = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    return got.select(*by, "n", *[F.round(c, 9).alias(name) for name, c in stats.wilson(F.col("k"), F.col("n")).items()])


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Leak terms: distinct ASCII words of 9 letters or more in the benchmark."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))).alias("term"))
    return words.where(F.length("term") >= 9).distinct()


LEAKS = """terms AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) WHERE length(term) >= 9),
  words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents), hits AS (SELECT doc_id, count(DISTINCT term) AS n FROM words JOIN terms USING (term) GROUP BY doc_id)"""


def leaks(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, n: how many leak terms a text holds; texts without any are absent. Words too short to be a term are left out before anything is a row."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{9,}"), F.lit(0)))
    words = table(spark, sf, "documents").select("doc_id", F.explode(words).alias("term"))
    return words.join(terms(spark, sf), "term").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f00_leaks_by_source", f"WITH {LEAKS}, x AS (SELECT source, CASE WHEN n > 0 THEN 1 ELSE 0 END AS correct FROM documents LEFT JOIN hits USING (doc_id)), y AS (SELECT source, count(*) AS n, {WILSON} FROM x GROUP BY source) SELECT source, n, {ROUNDED} FROM y")
def f00(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each source's documents that hold a leak term, with its interval."""
    docs = table(spark, sf, "documents").select("doc_id", "source").join(leaks(spark, sf), "doc_id", "left")
    return with_wilson(docs.withColumn("correct", F.col("n").isNotNull().cast("int")).drop("n"), "source")


@query("j14_leak_terms", f"WITH {LEAKS} SELECT doc_id, n FROM hits")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    """Leak terms in each text, whole words regardless of case, by an equi-join on words."""
    return leaks(spark, sf)


@query("a07_cells", R + "SELECT attacker, arm, count(*) AS files, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, max(k)::BIGINT AS most FROM (SELECT attacker, arm, file, count(*) AS n, sum(correct) AS k FROM r GROUP BY ALL) GROUP BY ALL")
def a07(spark: SparkSession, sf: str) -> DataFrame:
    """Cells by source file, then by arm and attacker."""
    per = records(spark, sf).groupBy("attacker", "arm", "file").agg(F.count("*").alias("n"), F.sum("correct").alias("k"))
    return per.groupBy("attacker", "arm").agg(F.count("*").alias("files"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("k").alias("most"))


@query("a08_pivot", R + "SELECT arm, round(avg(correct) FILTER (attacker = 'de'), 9) AS de, round(avg(correct) FILTER (attacker = 'en'), 9) AS en, round(avg(correct) FILTER (attacker = 'es'), 9) AS es, round(avg(correct) FILTER (attacker = 'fr'), 9) AS fr FROM r GROUP BY arm")
def a08(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of each arm by attacker, as columns."""
    got = records(spark, sf).groupBy("arm").pivot("attacker", ["de", "en", "es", "fr"]).agg(F.avg("correct"))
    return got.select("arm", *[F.round(c, 9).alias(c) for c in ("de", "en", "es", "fr")])


@query("a09_confident", R + "SELECT arm, count(*) FILTER (confidence >= 0.7) AS n, coalesce(sum(correct) FILTER (confidence >= 0.7), 0)::BIGINT AS k FROM r GROUP BY arm")
def a09(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of confident answers."""
    sure = F.col("confidence") >= 0.7
    return records(spark, sf).groupBy("arm").agg(F.count_if(sure).alias("n"), F.coalesce(F.sum(F.when(sure, F.col("correct"))), F.lit(0)).alias("k"))


@query("a10_panel", R + ", p AS (SELECT arm, attacker, avg(correct) AS p FROM r GROUP BY ALL) SELECT arm, round(max(p), 9) AS panel_max, round(max(p) - min(p), 9) AS spread, (SELECT attacker FROM p q WHERE q.arm = p.arm ORDER BY q.p DESC, attacker LIMIT 1) AS strongest FROM p GROUP BY arm")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    """Panel maximum, spread and strongest attacker, the first of equals."""
    rates = records(spark, sf).groupBy("arm", "attacker").agg(F.avg("correct").alias("p"))
    return rates.groupBy("arm").agg(F.round(F.max("p"), 9).alias("panel_max"), F.round(F.max("p") - F.min("p"), 9).alias("spread"), F.min_by("attacker", F.struct(-F.col("p"), "attacker")).alias("strongest"))


@query("a13_wilson", R + f", y AS (SELECT arm, attacker, count(*) AS n, {WILSON} FROM r GROUP BY ALL) SELECT arm, attacker, n, {ROUNDED} FROM y")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    """Wilson intervals of each cell."""
    return with_wilson(records(spark, sf), "arm", "attacker")


# As many as the reference makes, for both resampling queries.
DRAWS = 10_000


@query("a14_cluster_bootstrap")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of the difference between English and other documents, over source files."""
    cells = records(spark, sf).groupBy("arm", "file", (F.col("attacker") == "en").alias("side")).agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    return ev.cluster_bootstrap(cells, ["arm"], "file", "side", "k", "n", draws=DRAWS)


ITEMS = "SELECT source AS arm, d.doc_id % 12 AS truth, (d.doc_id % 12 + CASE WHEN quality = 1 THEN 0 ELSE 5 END) % 12 AS answer, d.doc_id % 30 AS file FROM documents d JOIN labels USING (doc_id)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    truth = F.col("doc_id") % 12
    return r.select("arm", "file", truth.alias("truth"), ((truth + F.when(F.col("correct") == 1, 0).otherwise(5)) % 12).alias("answer"))


@query("a15_permutation_null")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    """Observed rates against truths dealt anew over source files."""
    return ev.permutation_null(items(spark, sf), ["arm"], "file", "truth", "answer", draws=DRAWS)


@query("a15_analytic_null", f"WITH i AS ({ITEMS}), n AS (SELECT arm, count(*) AS n FROM i GROUP BY arm), a AS (SELECT arm, answer AS v, count(*) AS a FROM i GROUP BY ALL), t AS (SELECT arm, truth AS v, count(*) AS t FROM i GROUP BY ALL), s AS (SELECT arm, sum(a * t) AS s FROM a JOIN t USING (arm, v) GROUP BY arm) SELECT arm, round(coalesce(s, 0) / (n * n)::DOUBLE, 9) AS chance FROM n LEFT JOIN s USING (arm)")
def a15_analytic(spark: SparkSession, sf: str) -> DataFrame:
    """The rate of hits by chance."""
    return ev.analytic_null(items(spark, sf), ["arm"], "truth", "answer").select("arm", F.round("chance", 9).alias("chance"))


@query("a16_leak_attribution", f"WITH r AS ({RECORDS}), {LEAKS}, x AS (SELECT arm, n IS NOT NULL AS leaked, correct FROM r LEFT JOIN hits USING (doc_id)), b AS (SELECT arm FROM x GROUP BY arm HAVING count(DISTINCT leaked) = 2) SELECT arm, leaked, count(*) AS n, round(avg(correct), 9) AS rate FROM x WHERE arm IN (SELECT arm FROM b) GROUP BY ALL")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy by whether a term survived, for arms that have both."""
    x = records(spark, sf).join(leaks(spark, sf).select("doc_id", F.lit(True).alias("l")), "doc_id", "left").withColumn("leaked", F.coalesce("l", F.lit(False)))
    both = x.groupBy("arm").agg(F.countDistinct("leaked").alias("b")).where("b = 2").select("arm")
    return x.join(both, "arm", "left_semi").groupBy("arm", "leaked").agg(F.count("*").alias("n"), F.round(F.avg("correct"), 9).alias("rate"))


RATERS = "SELECT lang, quality AS x, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS y FROM documents JOIN labels USING (doc_id)"


@query("a17_kappa", f"WITH i AS ({RATERS}), s AS (SELECT lang, count(*) AS n, avg((x = y)::INT) AS po, (sum(x) * sum(y) + (count(*) - sum(x)) * (count(*) - sum(y))) / (count(*) * count(*))::DOUBLE AS pe FROM i GROUP BY lang) SELECT lang, n, round((po - pe) / (1 - pe), 9) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.6 THEN 'usable' ELSE 'descriptive only' END AS use FROM s WHERE pe < 1")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    """Cohen's kappa of two raters and what it allows."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 600).cast("int").alias("y"))
    rated = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("x")), "doc_id")
    k = stats.kappa(F.col("observed"), F.col("expected"))
    got = ev.confusion(rated, "x", "y", ["lang"]).where("expected < 1").select("lang", "n", k.alias("k"))
    return got.select("lang", "n", F.round("k", 9).alias("kappa"), F.when(F.col("k") >= stats.LEAST_KAPPA, "usable").otherwise("descriptive only").alias("use"))


@query("a18_tally", "SELECT source, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS unparsed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    """A tally of labels as columns, null as a label of its own."""
    label = F.coalesce(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"), F.lit("unparsed"))
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("label", label)
    return joined.groupBy("source").pivot("label", ["good", "bad", "unparsed"]).count().na.fill(0)


@query("a19_right_and_wrong", R + "SELECT arm, round(avg(confidence) FILTER (correct = 1), 9) AS when_right, round(avg(confidence) FILTER (correct = 0), 9) AS when_wrong FROM r GROUP BY arm")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    """Means by outcome."""
    hit = F.col("correct") == 1
    return records(spark, sf).groupBy("arm").agg(F.round(F.avg(F.when(hit, F.col("confidence"))), 9).alias("when_right"), F.round(F.avg(F.when(~hit, F.col("confidence"))), 9).alias("when_wrong"))


@query("a21_usage", "SELECT role, count(*) AS calls, count(u) AS with_usage, sum(u)::BIGINT AS tokens, CASE WHEN count(*) = count(u) THEN sum(u) END::BIGINT AS all_or_null FROM (SELECT role, CASE WHEN length(text) % 7 <> 0 OR role = 'system' THEN length(text) END AS u FROM conversations) GROUP BY role")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    """Sums where unknown isn't 0, and sums that are unknown if any part is."""
    used = F.when((F.length("text") % 7 != 0) | (F.col("role") == "system"), F.length("text"))
    return table(spark, sf, "conversations").select("role", used.alias("u")).groupBy("role").agg(F.count("*").alias("calls"), F.count("u").alias("with_usage"), F.sum("u").alias("tokens"), stats.sum_or_null(F.col("u")).alias("all_or_null"))


@query("a24_replicates", R + "SELECT arm, round(avg(confidence), 9) AS mean, min(confidence) AS low, max(confidence) AS high, round(max(confidence) - min(confidence), 9) AS spread, count(*) AS n, count(*) <> (SELECT max(c) FROM (SELECT count(*) AS c FROM r GROUP BY arm)) AS unequal FROM r GROUP BY arm")
def a24(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, extremes and range over replicates, and whether a group has fewer than the largest."""
    got = records(spark, sf).groupBy("arm").agg(F.round(F.avg("confidence"), 9).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count("*").alias("n"))
    most = got.agg(F.max("n").alias("most"))
    return got.crossJoin(F.broadcast(most)).select("arm", "mean", "low", "high", F.round(F.col("high") - F.col("low"), 9).alias("spread"), "n", (F.col("n") != F.col("most")).alias("unequal"))


@query("a25_upper_median", "SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY source")
def a25(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median, from counts of values: a window sees a group's different values, not its rows."""
    counts = table(spark, sf, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    every = Window.partitionBy("source")
    ranked = counts.withColumn("upto", F.sum("c").over(every.orderBy("n_chars"))).withColumn("half", F.floor(F.sum("c").over(every) / 2))
    return ranked.where("upto > half and upto - c <= half").select("source", F.col("n_chars").alias("median"))


@query("a26_ranked", R + ", s AS (SELECT arm, count(*) AS cases, sum(CASE WHEN confidence < 0.97 THEN 1 ELSE 0 END) AS passed, avg(correct) AS p FROM r GROUP BY arm) SELECT arm, round(p, 9) AS p FROM s WHERE cases = passed ORDER BY p DESC, arm")
def a26(spark: SparkSession, sf: str) -> DataFrame:
    """Only groups that pass all cases are ranked."""
    got = records(spark, sf).groupBy("arm").agg(F.count("*").alias("cases"), F.count_if(F.col("confidence") < 0.97).alias("passed"), F.avg("correct").alias("p"))
    return got.where("cases = passed").orderBy(F.desc("p"), "arm").select("arm", F.round("p", 9).alias("p"))


WORDSETS = "SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')) FILTER (role = 'user'))) AS a, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]+')) FILTER (role <> 'user'))) AS b FROM conversations GROUP BY conv_id"


@query("a27_set_f1", f"WITH w AS ({WORDSETS}), z AS (SELECT conv_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM w) SELECT conv_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 9) AS f1, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a)::DOUBLE END, 9) AS kept FROM z")
def a27(spark: SparkSession, sf: str) -> DataFrame:
    """F1 and retention of word sets of both sides of a conversation."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    side = lambda user: F.array_distinct(F.flatten(F.collect_list(F.when((F.col("role") == "user") == user, words))))
    got = table(spark, sf, "conversations").groupBy("conv_id").agg(side(F.lit(True)).alias("a"), side(F.lit(False)).alias("b"))
    return got.select("conv_id", F.round(stats.f1(F.col("a"), F.col("b")), 9).alias("f1"), F.round(stats.retention(F.col("a"), F.col("b")), 9).alias("kept"))


@query(
    "a28_relative_error",
    """WITH c AS (SELECT c_custkey, [[c_custkey % 7, c_custkey % 5], [c_custkey % 11, c_custkey % 3], [c_custkey % 2, c_custkey % 13]] AS pairs FROM customer),
    e AS (SELECT c_custkey, [round(1 - least(1.0, abs(p[2] - p[1]) / greatest(p[1], 1)::DOUBLE), 3) for p in pairs if p[1] <> 0 OR p[2] <> 0] AS per FROM c)
    SELECT c_custkey, CASE WHEN len(per) = 0 THEN 0.0 ELSE round(list_sum(per) / len(per), 3) END AS agreement FROM e""",
)
def a28(spark: SparkSession, sf: str) -> DataFrame:
    """How well counters are preserved: errors against the count before, 1 at most, zeros on both sides left out."""
    k = F.col("c_custkey")
    before, after = F.array(k % 7, k % 11, k % 2), F.array(k % 5, k % 3, k % 13)
    return table(spark, sf, "customer").select("c_custkey", stats.relative_agreement(before, after).alias("agreement"))


@query("a29_spread_by_label", "SELECT quality, min(n_chars) AS low, max(n_chars) AS high, arg_min(doc_id, (n_chars, doc_id)) AS weakest, arg_max(doc_id, (n_chars, -doc_id)) AS strongest FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def a29(spark: SparkSession, sf: str) -> DataFrame:
    """Extremes of each class and the rows that have them."""
    joined = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return joined.groupBy("quality").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("weakest"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("strongest"))


@query("a30_standardised", "SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_pop(s_acctbal) FROM supplier), 6) AS s_acctbal FROM supplier")
def a30(spark: SparkSession, sf: str) -> DataFrame:
    """Population standardisation."""
    return ev.standardised(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]).select("s_suppkey", F.round("s_acctbal", 6).alias("s_acctbal"))


@query(
    "a31_nearest_centroid",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
    s AS (SELECT label AS other, i, sum(x) AS s, count(*) AS n FROM x GROUP BY ALL), d AS (SELECT vec_id, label, other, sum((x - CASE WHEN label = other THEN (s - x) / (n - 1) ELSE s / n END) ** 2) AS d FROM x JOIN s USING (i) GROUP BY ALL)
    SELECT vec_id AS id, label, arg_min(other, (d, other)) AS nearest FROM d GROUP BY ALL""",
)
def a31(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest centroid of each vector, left out of its own class."""
    return ev.nearest_centroid(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


TITLES = r"SELECT page_id AS id, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]+')) AS token FROM pages"


def title_words(spark: SparkSession, sf: str) -> DataFrame:
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.explode(F.regexp_extract_all(title, F.lit("[a-z]+"), F.lit(0))).alias("token"))


@query(
    "j15_nearest_title",
    f"""WITH t AS ({TITLES}), c AS (SELECT id, token, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM t), d AS (SELECT token, count(*) AS df FROM c GROUP BY token),
    w AS (SELECT id, token, (1 + ln(c)) * ln(n / df::DOUBLE) AS w FROM c JOIN d USING (token), n WHERE df < n), m AS (SELECT id, sqrt(sum(w * w)) AS m FROM w GROUP BY id), u AS (SELECT id, token, w / m AS w FROM w JOIN m USING (id)),
    s AS (SELECT x.id, y.id AS other, round(sum(x.w * y.w), 9) AS s FROM u x JOIN u y ON x.token = y.token AND x.id <> y.id GROUP BY ALL)
    SELECT id, arg_max(other, (s, -other)) AS nearest, max(s) AS similarity FROM s GROUP BY id""",
)
def j15(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar other page title by tf-idf."""
    return joins.nearest_by_tokens(title_words(spark, sf))


@query(
    "a33_concentrated_tokens",
    """WITH t AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), p AS (SELECT token, source, count(*) AS files FROM t GROUP BY ALL), s AS (SELECT token, sum(files)::BIGINT AS total FROM p GROUP BY token)
    SELECT token, source, files, total FROM p JOIN s USING (token) WHERE total >= 3 AND files >= 3 AND files > 0.7 * total""",
)
def a33(spark: SparkSession, sf: str) -> DataFrame:
    """Words that one source has nearly alone."""
    words = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    return ev.concentrated(words, "doc_id", "source", "token").select("token", "source", "files", "total")


@query("a36_term_gate", "WITH t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM benchmark), s AS (SELECT term, count(*) AS items FROM t GROUP BY term) SELECT item_id, count(*) AS terms, count(*) FILTER (items > 1) AS shared, count(*) BETWEEN 15 AND 25 AS right_size FROM t JOIN s USING (term) GROUP BY item_id")
def a36(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of term lists and how many terms other lists have too."""
    t = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    shared = t.groupBy("term").agg(F.count("*").alias("items"))
    return t.join(shared, "term").groupBy("item_id").agg(F.count("*").alias("terms"), F.count_if(F.col("items") > 1).alias("shared"), F.count("*").between(15, 25).alias("right_size"))


@query("a37_corpus_gate", "SELECT source, count(*) AS files, count(*) FILTER (len(string_split(text, chr(10))) NOT BETWEEN 2 AND 100) AS out_of_envelope, count(*) FILTER (regexp_matches(text, '(?i)\\b(trash|worthless)\\b')) AS forbidden FROM documents GROUP BY source")
def a37(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each group outside an envelope of lines or with forbidden words."""
    lines = F.size(F.split("text", "\n"))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.count_if(~lines.between(2, 100)).alias("out_of_envelope"), F.count_if(F.col("text").rlike(r"(?i)\b(trash|worthless)\b")).alias("forbidden"))


@query(
    "a38_drift",
    "WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3), now AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 7) SELECT doc_id, CASE WHEN m.h IS NULL THEN 'added' WHEN now.h IS NULL THEN 'gone' ELSE 'changed' END AS drift FROM m FULL JOIN now USING (doc_id) WHERE m.h IS DISTINCT FROM now.h",
)
def a38(spark: SparkSession, sf: str) -> DataFrame:
    """What changed against a manifest of hashes; both sides are simulated from the texts."""
    docs, k = table(spark, sf, "documents"), F.col("doc_id") % 10
    manifest = docs.where(k != 3).select("doc_id", F.sha2("text", 256).alias("was"))
    now = docs.where(k != 7).select("doc_id", F.sha2(F.when(k == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("is"))
    drift = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "gone").otherwise("changed")
    return manifest.join(now, "doc_id", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("doc_id", drift.alias("drift"))


@query("a39_breaker", "WITH x AS (SELECT user_id, event_id, row_number() OVER w AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, min(event_id) AS tripped_at FROM x WHERE n >= 12 AND bad / n::DOUBLE > 0.25 GROUP BY user_id")
def a39(spark: SparkSession, sf: str) -> DataFrame:
    """The first event at which a running share of failures trips a breaker."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    x = ev.running(events, "user_id", "event_id", 100_000, {"n": F.lit(1), "bad": (F.col("event_type") == "error").cast("int")})
    return x.where("n >= 12 and bad / n > 0.25").groupBy("user_id").agg(F.min("event_id").alias("tripped_at"))


@query("a40_shared_domains", R + ", s AS (SELECT attacker, list_distinct(list(file) FILTER (arm = 'src0')) AS a FROM r GROUP BY attacker), t AS (SELECT attacker, arm, list_distinct(list(file)) AS b FROM r WHERE arm <> 'src0' GROUP BY ALL) SELECT arm, attacker, len(list_intersect(coalesce(a, []), b)) AS domains, len(list_intersect(coalesce(a, []), b)) < 3 AS too_few FROM t JOIN s USING (attacker)")
def a40(spark: SparkSession, sf: str) -> DataFrame:
    """Domains that both an arm and the source arm have."""
    r = records(spark, sf)
    files = r.select("arm", "attacker", "file").distinct()
    own = files.where("arm = 'src0'").select("attacker", "file", F.lit(1).alias("both"))
    got = files.where("arm <> 'src0'").join(own, ["attacker", "file"], "left").groupBy("arm", "attacker").agg(F.count("both").alias("domains"))
    return got.withColumn("too_few", F.col("domains") < stats.LEAST_DOMAINS)


@query("a41_status_histogram", "SELECT CASE WHEN quality IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'ok' ELSE 'poor' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def a41(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by status."""
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "unknown").when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "ok").otherwise("poor")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


VERDICT = R + """, c AS (SELECT arm, attacker, avg(correct) AS p, count(DISTINCT file) AS domains, avg(CASE WHEN confidence < 0.03 THEN 1.0 ELSE 0 END) AS failures FROM r GROUP BY ALL), s AS (SELECT attacker, p AS source_rate FROM c WHERE arm = 'src0'), b AS (SELECT attacker, p AS blind FROM c WHERE arm = 'src1')
  SELECT arm, attacker, CASE WHEN source_rate IS NULL THEN 'NOT EVALUATED' WHEN source_rate >= 0.9 AND failures <= 0.05 THEN 'VALID' ELSE 'INVALID' END AS gate,
  CASE WHEN source_rate IS NULL OR source_rate < 0.9 OR failures > 0.05 THEN 'NO VERDICT' WHEN domains < 3 THEN 'INCONCLUSIVE' WHEN blind IS NULL THEN 'NOT COMPUTABLE' WHEN p - blind <= 0.1 AND p <= 0.25 THEN 'PASS' WHEN p - blind >= 0.25 AND p - blind - 0.1 > 0 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict
  FROM c LEFT JOIN s USING (attacker) LEFT JOIN b USING (attacker)"""


@query("v01_verdicts", VERDICT)
def v01(spark: SparkSession, sf: str) -> DataFrame:
    """The validity gate and the verdict of each cell, in the order of the rules."""
    fail = F.when(F.col("confidence") < 0.03, 1.0).otherwise(0.0)
    cells = records(spark, sf).groupBy("arm", "attacker").agg(F.avg("correct").alias("p"), F.countDistinct("file").alias("domains"), F.avg(fail).alias("failures"))
    named = lambda arm, name: cells.where(F.col("arm") == arm).select("attacker", F.col("p").alias(name))
    got = cells.join(named("src0", "source_rate"), "attacker", "left").join(named("src1", "blind"), "attacker", "left")
    gate = stats.gate(F.col("source_rate"), F.col("failures"))
    diff = F.col("p") - F.col("blind")
    verdict = stats.verdict(gate, F.col("domains"), F.lit(0.0), F.col("blind").isNotNull(), F.lit(0.0), diff, diff - 0.1, F.col("p"), diff)
    return got.select("arm", "attacker", gate.alias("gate"), verdict.alias("verdict"))


@query("v03_leak_veto", f"WITH {LEAKS} SELECT source, round(count(n) / count(*)::DOUBLE, 9) AS hit_rate, count(n) / count(*)::DOUBLE >= 0.1 AS veto FROM documents LEFT JOIN hits USING (doc_id) GROUP BY source")
def v03(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose leak rate forbids a pass."""
    joined = table(spark, sf, "documents").select("doc_id", "source").join(leaks(spark, sf), "doc_id", "left")
    rate = F.count("n") / F.count("*")
    return joined.groupBy("source").agg(F.round(rate, 9).alias("hit_rate"), (rate >= stats.VETO_RATE).alias("veto"))


@query("p10_outcomes", "WITH c AS (SELECT conv_id, bool_and(text IS NULL OR length(text) < 60) AS none, max(CASE WHEN role = 'assistant' AND length(text) > 400 THEN 1 ELSE 0 END) AS parsed, count(*) >= 2 AS final FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN none THEN 'missing' WHEN parsed = 0 THEN 'unparseable' ELSE 'answered' END AS outcome, final FROM c")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    """Missing, unparseable or answered, from all attempts of a record."""
    none = F.bool_and(F.col("text").isNull() | (F.length("text") < 60))
    parsed = F.max(((F.col("role") == "assistant") & (F.length("text") > 400)).cast("int"))
    outcome = F.when(none, "missing").when(parsed == 0, "unparseable").otherwise("answered")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(outcome.alias("outcome"), (F.count("*") >= 2).alias("final"))


@query("p12_refusals", "SELECT doc_id, source = 'src0' AND split_part(CASE WHEN toxic = 1 THEN 'Refused: toxic' ELSE 'Error: other' END, ':', 1) = 'Refused' AS refused FROM documents JOIN labels USING (doc_id)")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals by the kind before the colon of an error."""
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    error = F.when(F.col("toxic") == 1, "Refused: toxic").otherwise("Error: other")
    return joined.select("doc_id", ((F.col("source") == "src0") & (F.split_part(error, F.lit(":"), F.lit(1)) == "Refused")).alias("refused"))


@query("p13_domain_split", "SELECT source, CASE WHEN (row_number() OVER (ORDER BY source) - 1) % 2 = 0 THEN 'selection' ELSE 'held-out' END AS split FROM (SELECT DISTINCT source FROM documents)")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted domains by turns."""
    return ev.domain_split(table(spark, sf, "documents"), "source")


@query("p14_in_range", f"WITH i AS ({ITEMS}) SELECT arm, count(*) AS n, count(*) FILTER (answer - 2 BETWEEN 1 AND 8) AS n_in_range FROM i GROUP BY arm")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    """Two numbers that must not be merged: all records, and those whose choice is on the menu."""
    return items(spark, sf).groupBy("arm").agg(F.count("*").alias("n"), F.count_if((F.col("answer") - 2).between(1, 8)).alias("n_in_range"))


@query("p21_guess_text", "SELECT conv_id, string_agg(CASE WHEN turn % 3 <> 1 THEN text END, ' ' ORDER BY turn) AS guess FROM conversations GROUP BY conv_id")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    """Parts joined by spaces, nulls left out."""
    part = F.when(F.col("turn") % 3 != 1, F.col("text"))
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    parts = F.filter(F.transform("ps", lambda x: x["p"]), lambda p: p.isNotNull())
    return lists.select("conv_id", F.when(F.size(parts) > 0, F.array_join(parts, " ")).alias("guess"))


DRAW = "('0x' || substr(md5('20260819:' || {}), 1, 8))::UBIGINT"


@query("w09_hash_sample", f"SELECT doc_id, source FROM documents WHERE {DRAW.format('doc_id')} < 0.2 * 4294967296")
def w09(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the items, by a hash of their id."""
    return ev.sample_by_hash(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 0.2)


@query("w09_exact_sample", f"SELECT doc_id, source FROM documents ORDER BY {DRAW.format('doc_id')}, doc_id LIMIT 100")
def w09_exact(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred of the items, those with the least hashes."""
    return ev.sample_exactly(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 100)


OPTIONS = ("billing", "catalogue", "fleet", "seismic", "radio", "weaving")


@query("w10_menus", f"SELECT conv_id, string_agg(o, ',' ORDER BY {DRAW.format("conv_id || ':' || o")}, o) AS menu FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest([{', '.join(repr(o) for o in OPTIONS)}]) AS o) GROUP BY conv_id")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """Options in an order that each item decides."""
    items = table(spark, sf, "conversations").select("conv_id").distinct()
    return items.select("conv_id", F.array_join(ev.menu(OPTIONS, F.col("conv_id")), ",").alias("menu"))


def verdict_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells, unreadable answers by attacker, vetoed arms, and domains by arm, of the records whose hit is a high quality or, in the source arm, any label."""
    r = records(spark, sf).withColumn("correct", F.when((F.col("arm") == "src0") | ((F.col("correct") == 1) & (F.col("doc_id") % F.ascii("arm") % 3 != 0)), 1).otherwise(0))
    cells = r.groupBy("arm", "attacker", "file").agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    failures = r.groupBy("attacker").agg(F.sum((F.col("confidence") < 0.03).cast("int")).alias("k"), F.count("*").alias("n"))
    return cells, failures, v03(spark, sf).where("veto").select(F.col("source").alias("arm")), r.groupBy("arm").agg(F.countDistinct("file").alias("domains"))


@query("v02_panel_verdicts")
def v02(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of arms against their strongest attackers: that attacker's blind rate and interval by files, the spread of attackers, the veto."""
    got = ev.panel_verdicts(*verdict_inputs(spark, sf), blind="src1", source="src0", draws=DRAWS)
    return got.select("arm", "attacker", *[F.round(c, 9).alias(c) for c in ("rate", "blind_rate", "low", "high", "spread")], "gate", "verdict")


@query(
    "v02_strongest_attackers",
    f"""WITH r AS (SELECT doc_id, source AS arm, lang AS attacker, CASE WHEN source = 'src0' OR (quality = 1 AND doc_id % ascii(source) % 3 <> 0) THEN 1 ELSE 0 END AS correct FROM documents JOIN labels USING (doc_id)), t AS (SELECT arm, attacker, avg(correct) AS p FROM r GROUP BY ALL),
    f AS (SELECT attacker, avg(CASE WHEN doc_id % 100 / 100.0 < 0.03 THEN 1.0 ELSE 0 END) AS f FROM r GROUP BY attacker), g AS (SELECT max(CASE WHEN s.p IS NULL AND f <= 0.05 THEN 1 WHEN s.p >= 0.9 AND f <= 0.05 THEN 0 ELSE 2 END) AS worst FROM f LEFT JOIN (SELECT * FROM t WHERE arm = 'src0') s USING (attacker)),
    b AS (SELECT arm, arg_min(attacker, (-p, attacker)) AS attacker, max(p) AS rate, max(p) - CASE WHEN count(*) < (SELECT count(*) FROM f) THEN least(min(p), 0) ELSE min(p) END AS spread FROM t WHERE arm NOT IN ('src0', 'src1') GROUP BY arm)
    SELECT b.arm, b.attacker, round(rate, 9) AS rate, round(s.p, 9) AS blind_rate, round(spread, 9) AS spread, CASE worst WHEN 0 THEN 'VALID' WHEN 1 THEN 'NOT EVALUATED' ELSE 'INVALID' END AS gate FROM b LEFT JOIN (SELECT * FROM t WHERE arm = 'src1') s ON s.attacker = b.attacker, g""",
)
def v02_strongest(spark: SparkSession, sf: str) -> DataFrame:
    """What the verdicts rest on besides the interval."""
    got = ev.panel_verdicts(*verdict_inputs(spark, sf), blind="src1", source="src0", draws=1)
    return got.select("arm", "attacker", *[F.round(c, 9).alias(c) for c in ("rate", "blind_rate", "spread")], "gate")


@query("x01_ordered_union", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def x01(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values in the order of first occurrence."""
    first = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), ",").alias("roles"))
