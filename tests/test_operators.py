"""Operators on small frames: edge cases and laws."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.functions import code, identifiers, literals, registry, similarity, stats
from larkspur.operators import evaluation, joins, search, tiers, updates
from larkspur.plans import registry as plans
from larkspur.sources import formats


def test_search_needs_a_filter(spark):
    with pytest.raises(ValueError, match="at least one"):
        search.search(spark.range(3), equal={"id": None})
    with pytest.raises(ValueError, match="every bound"):
        search.box(spark.range(3), {"id": (None, 3)})


@pytest.mark.parametrize(("given", "want"), [((None, None), (50, 0)), (("7", "3"), (7, 3)), (("0", "-1"), (50, 0)), (("201", "x"), (50, 0)), ((200, 0), (200, 0))])
def test_page_of(given, want):
    assert search.page_of(*given) == want


def test_children_of_a_childless_parent_are_empty(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, n int, x string")
    got = {r["k"]: [c["x"] for c in r["c"]] for r in search.children(parents, rows, "k", ["n"], ["x"], "c").collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_latest_prior_skips_same_time_and_untrusted(spark):
    df = spark.createDataFrame([(1, "m", 1, "S"), (2, "m", 2, "E"), (3, "m", 3, "S"), (4, "m", 3, "S"), (5, "n", 9, "S")], "id int, k string, day int, kind string")
    got = joins.latest_prior(df, "k", F.col("day"), F.col("kind") != "E", ["id"])
    assert {r["id"]: r["prior"] and r["prior"]["id"] for r in got.collect()} == {1: None, 2: 1, 3: 1, 4: 1, 5: None}


def test_longest_prefix(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/bc",), ("x",)], "p string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "r string")
    assert {r["p"]: r["r"] for r in joins.longest_prefix(df, "p", roots, "r").collect()} == {"a/b/c": "a/b", "a/bc": "a", "x": None}


@pytest.mark.parametrize(("used", "cents"), [(-5, 0), (0, 0), (100, 1000), (150, 1250), (600, 1000 + 2000 + 200)])
def test_tiers(spark, used, cents):
    rates = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(top).cast("long").alias("upper"), F.lit(rate).cast("long").alias("rate")) for n, top, rate in ((2, 500, 5), (1, 100, 10), (3, None, 2))])
    assert spark.range(1).select(tiers.tiered_charge(F.lit(used).cast("long"), rates).alias("c")).first()["c"] == cents


def test_upserts(spark):
    base = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (2, "first", 2), (2, "last", 3)], "k int, v string, pos int")
    assert {(r.k, r.v) for r in updates.insert_or_ignore(base, new, ["k"], "pos").collect()} == {(1, "old"), (2, "first")}
    assert {(r.k, r.v) for r in updates.insert_or_replace(base, new, ["k"], "pos").collect()} == {(1, "x"), (2, "last")}


def test_numbers_have_no_gaps(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 300, 7, 299, 1000)], "k long")
    got = {r["k"]: r["id"] for r in updates.numbered(df, "k", 100, "q%03d", "id").collect()}
    assert got == {k: f"q{i:03d}" for i, k in enumerate(sorted(got), 1)}


def test_maps_are_refused_anywhere(spark):
    updates.refuse_maps(spark.range(1))
    with pytest.raises(ValueError, match="re-identification"):
        updates.refuse_maps(spark.range(1).select(F.struct(F.lit(1).alias("reidentify_map")).alias("meta")))


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(65, 83), (0, 0), (5, 5)], "k int, n int")
    got = [tuple(round(x, 4) for x in r) for r in df.select(*[c.alias(n) for n, c in stats.wilson(F.col("k"), F.col("n")).items()]).collect()]
    assert got[0][1:] == (0.683, 0.8581) or abs(got[0][1] - 0.6830) < 1e-3
    assert got[1] == (0.0, 0.0, 1.0)
    assert got[2][2] == 1.0


def test_kappa_of_complete_chance_is_nan(spark):
    assert spark.range(1).select(F.isnan(stats.kappa(F.lit(1.0), F.lit(1.0)))).first()[0]


def test_permutation_null_extremes(spark):
    truth = [(f"f{i}", i % 3) for i in range(30)]
    items = spark.createDataFrame([("right", f, t, t) for f, t in truth] + [("one", f, t, 0) for f, t in truth], "arm string, file string, truth int, answer int")
    got = {r["arm"]: r for r in evaluation.permutation_null(items, ["arm"], "file", "truth", "answer", draws=50).collect()}
    assert got["right"]["p"] == pytest.approx(1 / 51)
    assert got["one"]["observed"] == pytest.approx(got["one"]["null_mean"])


def test_permutation_null_keeps_all_truths_of_a_unit(spark):
    items = spark.createDataFrame([("a", f"f{i % 10}", i % 4, i % 4) for i in range(40)] + [("a", "f0", 1, None)], "arm string, file string, truth int, answer int")
    r = evaluation.permutation_null(items, ["arm"], "file", "truth", "answer", draws=1200).first()
    assert r["observed"] == 1 and r["p"] == pytest.approx(1 / 1201) and abs(r["null_mean"] - 0.25) < 0.05


def test_registered_nulls_have_the_draws_of_the_reference(spark, sf):
    found = plans.queries()
    # Draws with an empty side are skipped; 1,000 were the most before.
    assert 5_000 < found["a14_cluster_bootstrap"](spark, sf).agg({"used": "max"}).first()[0] <= 10_000
    for r in found["a15_permutation_null"](spark, sf).collect():
        assert r["p"] * 10_001 == pytest.approx(round(r["p"] * 10_001), abs=1e-6) and r["low"] <= r["null_mean"] <= r["high"]


def test_bootstrap_interval_holds_the_difference(spark):
    cells = spark.createDataFrame([("a", i, s, (8 if s else 4) + i % 2, 10) for i in range(20) for s in (True, False)], "arm string, file int, side boolean, k long, n long")
    r = evaluation.cluster_bootstrap(cells, ["arm"], "file", "side", "k", "n", draws=200).first()
    assert r["low"] <= 0.4 <= r["high"] and r["used"] == 200


@pytest.mark.parametrize(
    ("content", "kind"),
    [("", "EMPTY"), (" \n ", "EMPTY"), ("https://a.example/x", "URL"), ("a.b@c.org", "EMAIL"), ("select x from y", "SQL"), ("application/json", "MSG"), ("09/26/2026", "MSG"), ("and/or", "MSG"), ("src/lib.go", "PATH"), ("./x", "PATH"), ("A" * 40, "MSG"), ("a1" * 20, "KEY"), ("sk_12345678", "KEY"), ("hello there.", "MSG")],
)
def test_literal_classes(spark, content, kind):
    assert spark.createDataFrame([(content,)], "s string").select(literals.literal_class(F.col("s"))).first()[0] == kind


def test_equal_literals_share_a_number(spark):
    df = spark.createDataFrame([(1, 0, "b.c/d"), (1, 1, "hi"), (1, 2, "b.c/d"), (1, 3, "yo")], "d int, pos int, s string")
    assert [r["tag"] for r in literals.tagged(df, "d", "pos", "s", 1).orderBy("pos").collect()] == ["<PATH:0>", "<MSG:0>", "<PATH:0>", "<MSG:1>"]
    assert [r["tag"] for r in literals.tagged(df, "d", "pos", "s", 0).orderBy("pos").collect()] == ["<LIT:0>", "<LIT:1>", "<LIT:0>", "<LIT:2>"]


def test_tagging_keeps_what_is_not_quoted(spark):
    df = spark.createDataFrame([(1, 'a "x y" b "x y" "z'), (2, "no quotes"), (3, None)], "d int, text string")
    got = {r["d"]: r["output"] for r in registry.transform(df, "tag-literals", doc="d").collect()}
    assert got == {1: 'a "<MSG:0>" b "<MSG:0>" "z', 2: "no quotes", 3: None}


def test_pseudonyms_keep_length_and_identity(spark):
    text = 'func total_price(unitPrice) { return unitPrice * total_price // unitPrice\n x = "unitPrice" }'
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    p = df.select("text", identifiers.pseudonymise(F.col("text"), bytes(16)).alias("p"))
    back = p.select("p", identifiers.reverse(F.col("p.output"), F.col("p.reidentify_map")).alias("b")).collect()
    assert len(back[0]["p"]["output"]) == len(text) and back[0]["b"]["output"] == text
    assert '"unitPrice"' in back[0]["p"]["output"] and back[0]["p"]["output"].startswith("func ")
    assert back[1]["p"]["output"] is None and back[2]["p"]["output"] == ""


def test_reverse_prefers_longer_keys_and_boundaries(spark):
    df = spark.createDataFrame([("abc xabc abc.d ab", {"abc": "one", "ab": "two", "c.d": "three"})], "t string, m map<string,string>")
    r = df.select(identifiers.reverse(F.col("t"), F.col("m")).alias("r")).first()["r"]
    assert (r["output"], r["substitutions"]) == ("one xabc one.d two", 3)


def test_key_policy():
    assert identifiers.load_key({"LARKSPUR_KEY": "00" * 20}) == bytes(16)
    assert len(identifiers.load_key({})) == 16
    with pytest.raises(ValueError):
        identifiers.load_key({"LARKSPUR_KEY": "0011"})


def test_counters(spark):
    df = spark.createDataFrame([('package x\nfunc a() {\n {} }\n"s"',), ("",)], "t string")
    got = [r.asDict() for r in df.select(*code.counters(F.col("t"), "go")).collect()]
    assert got[0] | {"lines": 4, "funcs": 1, "max_brace_depth": 2, "string_literals": 1} == got[0]
    assert got[1]["lines"] == 0 and got[1]["max_brace_depth"] == 0


def test_gate_refuses_an_echo(spark):
    text = "\n".join(f"line number_{i} of source_{i}" for i in range(24))
    other = "\n".join(f"word thing_{i} is wholly new_{i}" for i in range(24))
    df = spark.createDataFrame([(text, text), (text, other), ("a", "a")], "x string, y string")
    got = [r[0] for r in df.select(similarity.gate(similarity.report(F.col("x"), F.col("y")), F.lit(False))).collect()]
    assert got == ["refused: run", "passed", "too small"]


def test_blob_id(spark):
    assert spark.createDataFrame([("hello\n",)], "t string").select(code.blob_id(F.col("t"))).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_fixed_width_problems(spark):
    good = ["H20240101ROUTE1", "D" + "1".zfill(10) + "2".zfill(10) + "20240102" + "5".zfill(10) + "SY", "T00000001"]
    files = {"good": good, "count": [*good[:2], "T00000002"], "code": [good[0], good[1].replace("SY", "QY"), good[2]], "header": good[1:]}
    lines = spark.createDataFrame([(f, i, x) for f, xs in files.items() for i, x in enumerate(xs)], "file string, n int, line string")
    reads, problems = formats.fixed_width(lines)
    assert {r["file"]: r["problem"] for r in problems.collect()} == {"count": "wrong count", "code": "unknown read type", "header": "no header"}
    r = reads.where("file = 'good'").first()
    assert (r["read_date"], r["value"], r["read_type"], r["flag"]) == ("2024-01-02", 5, "SCHEDULED", True)


def test_length_tagged_bad_lengths(spark):
    df = spark.createDataFrame([("<a:2>xyz<b:99>end",), ("<a:q><b:1>k<fin><a:1>z",), (None,)], "t string")
    assert [tuple(r[0]) for r in df.select(formats.length_tagged(F.col("t"), ("a", "b"))).collect()] == [("xy", "end"), (None, "k"), (None, None)]


def test_headings(spark):
    df = spark.createDataFrame([("<!-- note -->\n## one\nbody\n## two\nmore\n",)], "t string")
    assert [tuple(x) for x in df.select(formats.headings(F.col("t"))).first()[0]] == [("one", "body\n"), ("two", "more\n")]


def test_duplicate_transform_is_an_error(spark):
    with pytest.raises(ValueError):
        registry.register_transform("reverse-text", "")(lambda df: df)
    assert [r["slug"] for r in registry.list_transforms(spark).collect()] == ["composed", "pseudonymise", "reverse-text", "tag-literals"]


def test_long_subfields_are_whole(spark):
    long = "x" * 150_000
    df = spark.createDataFrame([(f"=245  10$a{long}$btail",)], "text string")
    f = F.col("fields")
    r = formats.tagged_records(df).select(formats.field_value(f, "245", "a").alias("a"), formats.field_value(f, "245", "b").alias("b")).first()
    assert r["a"] == long and r["b"] == "tail"


def test_neighbours_are_found_over_few_tokens(spark):
    """Near copies among texts with common words: most tokens, and nearly all pairs, need no look."""
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    base = [[f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(12)] + [f"r{i}_{k}" for k in range(2)] for i in range(60)]
    texts = [(2 * i, b) for i, b in enumerate(base)] + [(2 * i + 1, [*b[1:], f"w{rng.randrange(400)}"]) for i, b in enumerate(base)]
    tokens = spark.createDataFrame([(i, t) for i, ts in texts for t in ts], "id int, token string")
    counts = {i: Counter(ts) for i, ts in texts}
    df = Counter(t for c in counts.values() for t in c)
    vectors = {}
    for i, c in counts.items():
        v = {t: (1 + math.log(k)) * math.log(len(texts) / df[t]) for t, k in c.items() if df[t] < len(texts)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    want = {i: min((-round(sum(w * vectors[j].get(t, 0.0) for t, w in v.items()), 9), j) for j in vectors if j != i) for i, v in vectors.items()}
    got = {r["id"]: (r["nearest"], r["similarity"]) for r in joins.nearest_by_tokens(tokens).collect()}
    assert got == {i: (j, pytest.approx(-s, abs=2e-9)) for i, (s, j) in want.items()}
    unit = joins.weighted_tokens(tokens).cache()
    left = joins.needed_tokens(unit, spark.createDataFrame([(i, -s) for i, (s, _) in want.items()], "id int, similarity double"), 2)
    pairs = lambda d: d.agg(F.sum(F.col("df") - 1)).first()[0] or 0
    assert pairs(unit.where("place <= 2")) + pairs(left) < 0.2 * pairs(unit)


def test_copies_of_texts_are_looked_for_once(spark):
    """Copies, and texts as like as copies with other counts: the smallest other id counts, and no pairs of copies are made."""
    texts = {5: "a b", 1: "c d", 7: "a b", 9: "a b", 2: "a a b b", 3: "c d e", 4: "c d", 6: "f", 8: "f g", 10: "h"}
    tokens = spark.createDataFrame([(i, t) for i, x in texts.items() for t in x.split()], "id long, token string")
    got = {r["id"]: (r["nearest"], r["similarity"]) for r in joins.nearest_by_tokens(tokens).collect()}
    assert {i: got[i] for i in (5, 7, 9, 2, 1, 4)} == {5: (2, 1.0), 7: (2, 1.0), 9: (2, 1.0), 2: (5, 1.0), 1: (4, 1.0), 4: (1, 1.0)}
    assert got[3][0] == 1 and got[6][0] == 8 and got[8][0] == 6 and 10 not in got
    counts = tokens.groupBy("id", "token").agg(F.count("*").alias("c"))
    members, seconds = joins._equal_texts(counts)
    assert {(r["id"], r["first"]) for r in members.where("id <> first").collect()} == {(4, 1), (7, 5), (9, 5)}
    assert {tuple(r) for r in seconds.collect()} == {(1, 4), (5, 7)}
