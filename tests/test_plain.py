"""Operators without SQL against plain versions, and malformed input."""

from __future__ import annotations

import random
import re
import time
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import code, identifiers, literals, registry, similarity, stats
from larkspur.operators import associate, evaluation, joins, runs, search, updates
from larkspur.plans import registry as plans
from larkspur.sources import formats

QUOTES = ('"""', "'''", '"', "'", "`")


def plain_literals(text):
    """(start, end, quote) of each literal, by walking the text."""
    out, i = [], 0
    while i < len(text):
        for q in QUOTES:
            if not text.startswith(q, i):
                continue
            j = i + len(q)
            while j < len(text) and not text.startswith(q, j):
                if q == "'" and text[j] == "\n":
                    j = len(text) + 1
                    break
                j += 2 if text[j] == "\\" else 1
            if j <= len(text) - len(q):
                out.append((i, j + len(q), q))
                i = j + len(q)
                break
        else:
            i += 1
    return out


def plain_tagged(text, kinds):
    """(output, literals by class); kinds: content -> class."""
    numbers, by_class, parts, last = {}, Counter(), [], 0
    for a, z, q in plain_literals(text):
        content = text[a + len(q) : z - len(q)]
        if q == "'" and re.fullmatch(literals.RUNE, content):
            continue
        kind = kinds[content]
        by_class[kind] += 1
        n = numbers.setdefault((kind, content), sum(k == kind for k, _ in numbers))
        parts += [text[last : a + len(q)], f"<{kind}:{n}>", q]
        last = z
    return "".join([*parts, text[last:]]), dict(by_class)


TEXTS = [
    'x = "a\\"b" + \'c d\' + `e` + """f "g" h""" + \'\'\'i\nj\'\'\'', "don't pair\nwith 'this one' or 'x' or '\\n' or '\\u00e9'", 'open "no end', "a ` b\n` c", '"" \'\' ``', '"x" "y" "x" "https://a.example/b?c" "select a from b"', "'it\\'s' \"\"\"\" tail", '"' + '\\"' * 300, "",
]


def test_tagging_equals_a_plain_walk(spark, sf):
    pages = [r[0] for r in duckdb.sql(f"select html from '{sf}/pages.parquet'").fetchall()]
    texts = TEXTS + pages
    contents = sorted({t[a + len(q) : z - len(q)] for t in texts for a, z, q in plain_literals(t)})
    kinds = {r["s"]: r["k"] for r in spark.createDataFrame([(c,) for c in contents], "s string").select("s", literals.literal_class(F.col("s")).alias("k")).collect()}
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    for r in registry.transform(df, "tag-literals", doc="d").collect():
        output, by_class = plain_tagged(texts[r["d"]], kinds)
        assert r["output"] == output and r["literals_by_class"] == by_class and r["total_literals"] == sum(by_class.values())


@pytest.mark.parametrize("text", ['"' + '\\"' * 50_000, "'" + "a'" * 50_000, "x" * 100_001, "`" + "\\`" * 50_000, "/*" * 50_000, '"""' * 33_334])
def test_time_is_linear_in_the_text(spark, text):
    df = spark.createDataFrame([(1, text)], "d int, text string").cache()
    df.count()
    spark.createDataFrame([(1, "x 'y'")], "d int, text string").select(identifiers.checked(F.col("text"), bytes(16))).collect()
    runs = {
        "tags": lambda: registry.transform(df, "tag-literals", doc="d").select("output").collect(),
        "counters": lambda: df.select(*code.counters(F.col("text"), "ts")[:7]).collect(),
        "pseudonyms": lambda: df.select(identifiers.checked(F.col("text"), bytes(16))["round_trip"]).collect(),
        "code lines": lambda: df.select(code.code_lines(F.col("text"))).collect(),
    }
    for name, run in runs.items():
        began = time.time()
        run()
        assert time.time() - began < 10, name


def test_composed_is_both_in_turn(spark):
    df = spark.createDataFrame([(1, 'total_price("a b", unit_price)')], "d int, text string")
    mid = registry.transform(df, "tag-literals", doc="d").select("d", F.col("output").alias("text"))
    want = mid.select(identifiers.pseudonymise(F.col("text"), bytes(16))["output"]).first()[0]
    got = registry.transform(df, "composed", doc="d", key=bytes(16)).first()
    assert got["output"] == want and got["chain"] == ["tag-literals", "pseudonymise"] and "reidentify_map" not in got.asDict()


def test_many_quotes_give_the_same_pseudonyms(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["'", '"', "\\\\", "\n", " ", "ab_c ", "//x", "1a ", "#"]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    once = [identifiers.pseudonymise_one(t, bytes(16), 1, {}) for t in texts]
    monkeypatch.setattr(identifiers, "FEW_QUOTES", 0)
    assert [identifiers.pseudonymise_one(t, bytes(16), 1, {}) for t in texts] == once


def test_pseudonymised_equals_a_plain_pass(spark, sf):
    got = {r["doc_id"]: r for r in plans.queries()["t07_pseudonymised"](spark, sf).collect()}
    for i, text in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        words = [m["word"] for m in identifiers.TOKEN.finditer(text) if m["word"] and not identifiers.spared(1, m["word"])]
        names = {w: identifiers.pseudonym(bytes(range(16)), w) for w in set(words)}
        assert (got[i]["replaced"], got[i]["distinct"], got[i]["collisions"]) == (len(words), len(names), len(names) - len(set(names.values())))
        assert got[i]["same_length"] and got[i]["round_trip"] == (len(set(names.values())) == len(names) and not set(names.values()) & (set(identifiers.WORD_KEY.findall(text)) - set(names)))


def longest_common_runs(a, b):
    """Sizes of the runs of equal lines that a longest-first split finds."""
    best = max(((i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]), key=lambda p: (run(a, b, *p), -p[0], -p[1]), default=None)
    if best is None:
        return []
    i, j = best
    n = run(a, b, i, j)
    return longest_common_runs(a[:i], b[:j]) + [n] + longest_common_runs(a[i + n :], b[j + n :])


def run(a, b, i, j):
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def test_similarity_equals_plain_counts(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(30):
        a = [f"name_{rng.randrange(12)} = self.call_{rng.randrange(5)}(xyz, {rng.choice(['append', 'return', 'print', 'isoformat', 'é'])})" for _ in range(rng.randrange(1, 40))]
        b = [x if rng.random() < 0.7 else f"other_{rng.randrange(9)}" for x in a]
        rows.append(("\n".join(a), "\n".join(b)))
    for (x, y), r in zip(rows, spark.createDataFrame(rows, "x string, y string").select(similarity.report(F.col("x"), F.col("y")).alias("r")).collect(), strict=True):
        a, b, r = x.split("\n"), y.split("\n"), r["r"]
        sizes = longest_common_runs(a, b)
        assert (r["src_lines"], r["out_lines"], r["longest_run"]) == (len(a), len(b), max(sizes, default=0))
        assert r["copied_spans"] == sum(s >= 5 for s in sizes) and r["copied_share"] == round(sum(s for s in sizes if s >= 5) / len(a), 3)
        assert r["verbatim"] == round(sum(line in a for line in b) / len(b), 3) and r["ratio"] == round(SequenceMatcher(None, x, y).ratio(), 3)
        # Identifiers of four characters or more of code lines, but for what the language and its libraries own.
        spared = {"self", "append", "return", "print", "isoformat"}
        own, words = ({w for line in t if not line.startswith("//") for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]{3,}", line)} - spared for t in (a, b))
        assert r["retention"] == round(len(own & words) / len(own), 3)


def test_file_scores(spark):
    source = "package a\n// note on Turbine blades\nfunc turbine() {\n  if x { return rotor }\n}\n/* block\nfor y\n*/ gone\nfor i {\n}\n"
    r = spark.createDataFrame([(source, source), (source, "package a\nfunc pump() {\n}\nTURBINE blades here\n")], "x string, y string").select(similarity.scores(F.col("x"), F.col("y"), ["turbine", "turbine blades", "rotor"]).alias("s")).collect()
    same, other = r[0]["s"], r[1]["s"]
    assert (same["shape_fidelity"], same["domain_retention"], same["leak_lines"], same["leak_lines_verbatim"]) == (1.0, 1.0, 3, 3)
    # Of def, branch and loop one stays; of the terms the longer one is named.
    assert other["shape_fidelity"] == round(1 - 2 / 3, 3) and other["leak_lines"] == 1 and other["leak_lines_verbatim"] == 0
    assert other["domain_terms"] == 3 and other["domain_retention"] == round(1 / 3, 3)
    assert same["leak_terms"] == {"turbine": 1, "turbine blades": 1, "rotor": 1} and other["leak_terms"] == {"turbine blades": 1}
    assert (same["shape_loss"], same["passthrough"]) == ({}, True) and other["shape_loss"] == {"branch": 1, "loop": 1} and not other["passthrough"]


def test_leaked_modules(spark):
    source = 'package a\nimport (\n\t"ledger.app/x"\n\t"turbines/db"\n)\n'
    got = spark.createDataFrame([(source, "the Turbines of"), (source, "turbines_db"), ("", "turbines"), (source, None)], "x string, y string").select(similarity.leaked(F.col("x"), F.col("y")).alias("l")).collect()
    assert [r["l"] for r in got] == [True, False, False, None]


def test_ratio_of_long_texts(monkeypatch):
    monkeypatch.setattr(similarity, "EXACT_CHARS", 100)
    long = "\n".join(f"value_{i} = compute_{i}(x)" for i in range(30))
    assert similarity.inspect(long, long)["ratio"] == 1.0 and similarity.inspect(long, "zzz" * 200)["ratio"] is None and similarity.inspect("ab", "cd")["ratio"] == 0.0


@pytest.mark.parametrize(
    ("text", "suffix", "want"),
    [
        ("a // b\n\n// c\n/* d\n e */ f\n* g\nh\n x := \"//\" // y", ".go", ["a", "h", 'x := "//" // y']),
        ("/* one line */ a\n/* never\nends", ".ts", []),
        ('a # b\n# c\n"""doc\nstring""" d\ne = """f""" + 1\ng = "#" # h', ".py", ["a", "e =  + 1", 'g = "#" # h']),
        ("", ".go", []),
    ],
)
def test_code_lines(spark, text, suffix, want):
    assert similarity.code_lines(text, suffix) == want
    if suffix != ".py":
        assert spark.createDataFrame([(text,)], "t string").select(code.code_lines(F.col("t"))).first()[0] == want


def test_own_modules_and_profiles(spark):
    go = 'package a\n\nimport (\n\t"fmt"\n\t"ledger/db"\n\t_ "github.com/acme-org/turbines/internal/x"\n\t"github.com/other/lib"\n\t"app/x"\n)\n\nfunc (s *S) get(w http.ResponseWriter, r *R) {\n}\n\nfunc Do() { x("s") }\n\ntype T struct {\n}\n'
    r = spark.createDataFrame([(go,)], "t string").select(code.own_modules(F.col("t")).alias("m"), code.profile(F.col("t"), "go").alias("p")).withColumn("f", code.foreign_words(F.col("p"))).first()
    assert r["m"] == ["acme-org", "ledger", "turbines"]
    assert "functions: 2\nhandlers: 1\nstructs: 1\ninterfaces: 0\nimports: 5\nexports: 2\n" in r["p"] and r["f"] == []
    assert spark.range(1).select(code.foreign_words(F.lit("lines: 3\nturbine: 1"))).first()[0] == ["turbine"]


def plain_fenced(text, source=""):
    """(body, discarded characters), or None where the reply is refused."""
    is_fence = lambda x: re.match(r"^```[^`]*$", x.rstrip())

    def unwrapped(s):
        if not s.startswith("```") or "\n" not in s:
            return s
        return s[s.find("\n") + 1 :].removesuffix("```").rstrip()

    s = text.strip()
    lines = s.split("\n")
    fences = [i for i, x in enumerate(lines) if is_fence(x)]
    if not fences or any(map(is_fence, source.splitlines())) or (fences[0] == 0 and (len(fences) == 1 or fences[1] == len(lines) - 1)):
        return unwrapped(s), 0
    before = [x for x in lines[: fences[0]] if x.strip()]
    prose = all(len(x.split()) >= 3 and x.strip()[-1] in ":.!" and not set(x) & set("{};=") for x in before)
    if len(fences) > 2 or len(before) > 3 or not prose or (len(fences) == 2 and lines[fences[1]].rstrip() != "```"):
        return None
    close = fences[1] if len(fences) == 2 else len(lines)
    body = "\n".join(lines[fences[0] + 1 : close])
    return (body.removesuffix("```") if len(fences) == 1 else body).rstrip(), sum(map(len, lines[: fences[0]] + lines[close + 1 :]))


def test_fenced_replies_equal_the_plain_rule(spark):
    rng = random.Random(3)
    parts = ["```", "```go", "``` ", "x = 1", "Here is it:", "Here it is.", "no", "", "It {is} this:", "a ``` b", "  ", "end```", "````"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(600)]
    rows = [(t, rng.choice(["", "x", "a\n```py\nb"])) for t in texts]
    got = spark.createDataFrame(rows, "t string, s string").select("t", "s", code.fenced(F.col("t"), F.col("s")).alias("r")).collect()
    seen = set()
    for r in got:
        want = plain_fenced(r["t"], r["s"])
        assert (r["r"]["body"], r["r"]["discarded"]) == (want or (None, None)) and (r["r"]["error"] is None) == (want is not None), (r["t"], r["s"])
        seen.add((want is None, bool(want and want[1])))
    assert len(seen) == 3
    assert spark.range(1).select(code.fenced(F.lit(None).cast("string")).alias("r")).first()["r"] is None


def test_suffixes(spark):
    texts = {"package a\n": ".go", "// c\npackage math // import \"math\"\n": ".go", "package a.b;\nclass X {}": ".py", "x package y func z": ".go", "const a = 1": ".ts", "const a = 1\ndef f(): pass": ".py", "": ".py", "x" * 4000 + "const a": ".py", "let f = () => {}": ".ts", "let f = () => 1": ".ts"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", code.suffix(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == texts
    given = {"ts": ".ts", ".TS": ".ts", " go ": ".go", "  ": None, None: None}
    got = spark.createDataFrame([(t,) for t in given], "t string").select("t", code.dotted_suffix(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == given


def test_relative_agreement_equals_the_plain_rule(spark):
    def plain(a, b):
        per = [round(1.0 - min(1.0, abs(y - x) / max(x, 1)), 3) for x, y in zip(a, b, strict=True) if x or y]
        return round(sum(per) / len(per), 3) if per else 0.0

    rows = [([0, 0], [0, 0]), ([0, 4], [3, 4]), ([10, 1], [3, 9]), ([5, 0], [5, 0]), ([3], [4]), ([7, 2, 0], [6, 2, 1])]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(stats.relative_agreement(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == [plain(*r) for r in rows]


def test_failing_rows_are_results(spark):
    class Refused(Exception):
        code = "gate"

    def run(text, n):
        if text == "refuse":
            raise Refused("no")
        if text == "short":
            return (text,)
        return text.upper(), 10 // n

    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate([("a", 2), (None, 1), ("b", 0), ("refuse", 1), ("short", 1), ("c", 5)])], "i int, text string, n int").repartition(3)
    cases = runs.run_cases(df, ["i"], run, ["text", "n"], "up string, tenth long").cache()
    got = {r["i"]: (r["up"], r["tenth"], r["error"] and r["error"]["code"]) for r in cases.collect()}
    assert got == {0: ("A", 5, None), 1: (None, None, "AttributeError"), 2: (None, None, "ZeroDivisionError"), 3: (None, None, "gate"), 4: (None, None, "ValueError"), 5: ("C", 2, None)}
    assert cases.where("elapsed_ms >= 0").count() == 6 and cases.where("i = 2").first()["error"]["detail"].startswith("ZeroDivisionError: ")
    assert {r["error_code"]: r["cases"] for r in runs.summary(cases).collect()} == {None: 2, "AttributeError": 1, "ZeroDivisionError": 1, "gate": 1, "ValueError": 1}
    assert sorted(r["i"] for r in runs.retried(cases, ["gate"]).collect()) == [1, 2, 4]
    one = runs.run_cases(df, ["i"], lambda t: t * 2, ["text"], "twice string")
    assert {r["i"]: r["twice"] for r in one.collect()}[0] == "aa" and one.where("error is not null").count() == 1
    assert runs.run_cases(df.limit(0), ["i"], run, ["text", "n"], "up string, tenth long").count() == 0


def test_maps_are_refused_within_maps(spark):
    hidden = F.struct(F.lit(1).alias("reidentify_map"))
    for c in (F.create_map(F.lit("a"), hidden), F.array(F.create_map(F.lit("a"), F.array(hidden))), F.create_map(hidden, F.lit(1))):
        with pytest.raises(ValueError, match="re-identification"):
            updates.refuse_maps(spark.range(1).select(c.alias("x")))


def test_reload_seed_log_and_drift(spark, tmp_path):
    one, none = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([], "k int, v string")
    assert updates.seed_if_empty(none, one).count() == 1 and updates.seed_if_empty(one, one.union(one)).count() == 1
    for rows in (one.union(one), one):
        updates.reload({"t": rows}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 1
    for _ in range(2):
        updates.append_log(one, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    was, now = (spark.createDataFrame(rows, "key string, value string") for rows in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert sorted(tuple(r) for r in updates.drift(was, now).collect()) == [("b", "2", "9"), ("c", "3", None), ("d", None, "4")]
    with pytest.raises(Exception, match="must not change"):
        updates.drift(was, now, ["b"]).collect()


def test_columns_that_must_not_leave(spark):
    df = spark.createDataFrame([(1, "x")], "id int, key string")
    assert search.without(df, "key").columns == ["id"]
    with pytest.raises(ValueError, match="no such"):
        search.without(df, "secret")


def test_nearest_by_tokens_with_common_tokens(spark):
    rng = random.Random(3)
    tokens = [(i, f"t{rng.randrange(4) if rng.random() < 0.8 else rng.randrange(60)}") for i in range(60) for _ in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(tokens, "id int, token string")
    plain = {r["id"]: (r["nearest"], r["similarity"]) for r in joins.nearest_by_tokens(df, common=1000).collect()}
    counts = {i: Counter(t for j, t in tokens if j == i) for i, _ in tokens}
    freq = Counter(t for c in counts.values() for t in c)
    vec = {i: {t: (1 + np.log(k)) * np.log(len(counts) / freq[t]) for t, k in c.items() if freq[t] < len(counts)} for i, c in counts.items()}
    norm = {i: np.sqrt(sum(w * w for w in v.values())) for i, v in vec.items()}
    want = {}
    for i, v in vec.items():
        sims = [(-round(sum(w * vec[j][t] for t, w in v.items() if t in vec[j]) / norm[i] / norm[j], 9), j) for j in vec if j != i and set(v) & set(vec[j])]
        if sims:
            want[i] = (min(sims)[1], -min(sims)[0])
    assert plain == want
    for common in (1, 5, 20):
        assert {r["id"]: (r["nearest"], r["similarity"]) for r in joins.nearest_by_tokens(df, common=common).collect()} == want


def test_nearest_centroid_in_blocks(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), i % 9) for i in range(90)], "id int, v array<double>, label int")
    whole = {tuple(r) for r in evaluation.nearest_centroid(df, "id", "v", "label").collect()}
    assert len(whole) == 90 and {tuple(r) for r in evaluation.nearest_centroid(df, "id", "v", "label", block=7).collect()} == whole


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, rng.randrange(5)) for i in rng.sample(range(500), 200)]
    got = evaluation.running(spark.createDataFrame(rows, "k int, i int, v int"), "k", "i", 40, {"s": F.col("v"), "n": F.lit(1)}).collect()
    for r in got:
        before = [v for k, i, v in rows if k == r["k"] and i <= r["i"]]
        assert (r["s"], r["n"]) == (sum(before), len(before))


def test_menus_favour_no_place(spark):
    places = Counter(r[0].index("a") for r in spark.range(3000).select(evaluation.menu("abcde", F.col("id"))).collect())
    assert set(places) == set(range(5)) and min(places.values()) > 500
    assert evaluation.sample_exactly(spark.range(100), "id", 7).count() == 7 and evaluation.sample_exactly(spark.range(3), "id", 7).count() == 3


def test_bootstrap_equals_resampling_clusters(spark):
    rng = np.random.default_rng(6)
    cells = [("a", i, s, int(rng.integers(0, 11)), 10) for i in range(25) for s in (True, False)]
    r = evaluation.cluster_bootstrap(spark.createDataFrame(cells, "arm string, file int, side boolean, k long, n long"), ["arm"], "file", "side", "k", "n", draws=4000).first()
    k = np.array([[c[3] for c in cells if c[1] == i] for i in range(25)])
    diffs = np.sort([(lambda d: (d[:, 0].sum() - d[:, 1].sum()) / 250)(k[rng.integers(0, 25, 25)]) for _ in range(4000)])
    assert r["diff"] == pytest.approx((k[:, 0].sum() - k[:, 1].sum()) / 250)
    assert abs(r["low"] - diffs[100]) < 0.03 and abs(r["high"] - diffs[3899]) < 0.03


def test_permutation_null_equals_plain_dealing(spark):
    rng = np.random.default_rng(7)
    items = [("a", f"f{i % 12}", int(i % 12 % 4), int(rng.integers(0, 4))) for i in range(120)]
    r = evaluation.permutation_null(spark.createDataFrame(items, "arm string, file string, truth int, answer int"), ["arm"], "file", "truth", "answer", draws=3000).first()
    truth = np.array([i % 4 for i in range(12)])
    unit, answer = np.array([int(f[1:]) for _, f, _, _ in items]), np.array([a for *_, a in items])
    rates = [(rng.permutation(truth)[unit] == answer).mean() for _ in range(3000)]
    observed = (truth[unit] == answer).mean()
    assert r["observed"] == pytest.approx(observed) and abs(r["null_mean"] - np.mean(rates)) < 0.01
    assert abs(r["p"] - (sum(x >= observed for x in rates) + 1) / 3001) < 0.05


def plain_verdicts(cells, failures, vetoed, domains, ends):
    """arm -> (attacker, rate, its blind rate, spread, verdict) of cells (arm, attacker, file, k, n); ends: intervals by arm."""
    attackers = sorted({a for _, a, *_ in cells})

    def agg(attacker, arm):
        own = [(k, n) for x, a, _, k, n in cells if (x, a) == (arm, attacker)]
        return sum(k for k, _ in own), sum(n for _, n in own)

    gate_ok, gate_failed = True, False
    for a in attackers:
        k, n = agg(a, "source")
        fk, fn = failures.get(a, (0, 0))
        failed = fk / fn if fn else 0.0
        ok = (k / n if n else 0.0) >= 0.90 and failed <= 0.05
        gate_ok &= ok
        if n or failed > 0.05:
            gate_failed |= not ok
    out = {}
    for arm in sorted({x for x, *_ in cells} - {"blind", "source"}):
        best = max(attackers, key=lambda a: agg(a, arm)[0] / max(1, agg(a, arm)[1]))
        hk, hn = agg(best, arm)
        if not hn:
            continue
        p, (bk, bn) = hk / hn, agg(best, "blind")
        rates = [agg(a, arm)[0] / max(1, agg(a, arm)[1]) for a in attackers]
        spread, short = max(abs(x - y) for x in rates for y in rates), domains[arm] < 3
        veto = arm in vetoed and gate_ok and not short
        low, high = ends[arm]
        if not bn:
            out[arm] = (best, p, None, spread, "FAIL: veto" if veto else "NOT COMPUTABLE")
            continue
        if not gate_ok:
            v = "INCONCLUSIVE: gate " + ("invalid" if gate_failed else "not evaluated")
        elif short:
            v = "INCONCLUSIVE: domains"
        elif spread > 0.20:
            v = "INCONCLUSIVE: spread"
        elif high <= 0.10 and p <= 0.25:
            v = "PASS"
        elif p - bk / bn >= 0.25 and low > 0:
            v = "FAIL"
        else:
            v = "INCONCLUSIVE"
        out[arm] = (best, p, bk / bn, spread, "FAIL: veto" if veto and v != "FAIL" else v)
    return out


def plain_ends(cells, arm, attacker, rng, draws=3000):
    own = {name: {f: (k, n) for x, a, f, k, n in cells if (x, a) == (name, attacker)} for name in (arm, "blind")}
    files = sorted({f for x in own.values() for f in x})
    diffs = []
    for _ in range(draws):
        pick = [files[i] for i in rng.integers(0, len(files), len(files))]
        (hk, hn), (bk, bn) = ([sum(x.get(f, (0, 0))[i] for f in pick) for i in (0, 1)] for x in (own[arm], own["blind"]))
        if hn and bn:
            diffs.append(hk / hn - bk / bn)
    diffs.sort()
    return diffs[int(0.025 * (len(diffs) - 1))], diffs[int(0.975 * (len(diffs) - 1))]


# The rate of each arm and attacker, x standing for no answers; unreadable answers of attacker a; arms with a veto.
PANELS = {
    "rules": ({"source": "999", "blind": "111", "same": "112", "worse": "666", "apart": "268", "few": "111", "leaky": "111", "gone": "x11"}, 0, {"leaky", "few", "worse"}),
    "invalid": ({"source": "988", "blind": "111", "same": "112"}, 0, {"same"}),
    "unread": ({"source": "999", "blind": "111", "same": "112"}, 9, set()),
    "no source": ({"blind": "111", "same": "112"}, 0, {"same"}),
    "no blind": ({"source": "999", "blind": "1x1", "one": "181", "two": "811", "leaky": "282"}, 0, {"leaky"}),
}


@pytest.mark.parametrize("panel", PANELS)
def test_panel_verdicts_equal_the_plain_rules(spark, panel):
    arms, unread, vetoed = PANELS[panel]
    # Attackers b and c tie where their rates do; the first by name counts.
    cells = [(arm, "abc"[i], f"f{f}", round(20 * int(r) / 9) if arm == "source" else int(r) * 2 + (f % 2 if 0 < int(r) < 9 else 0), 20) for arm, rates in arms.items() for i, r in enumerate(rates) if r != "x" for f in range(30)]
    failures, domains = {"a": (unread, 100), "b": (0, 100)}, {arm: 2 if arm == "few" else 5 for arm in arms}
    got = evaluation.panel_verdicts(
        spark.createDataFrame(cells, "arm string, attacker string, file string, k long, n long"), spark.createDataFrame([(a, *x) for a, x in failures.items()], "attacker string, k long, n long"),
        spark.createDataFrame([(v,) for v in vetoed], "arm string"), spark.createDataFrame(list(domains.items()), "arm string, domains long"), "blind", "source", 3000,
    ).collect()
    ends = {r["arm"]: (r["low"] or 0.0, r["high"] or 0.0) for r in got}
    want = plain_verdicts(cells, failures, vetoed, domains, ends)
    assert {r["arm"]: (r["attacker"], r["blind_rate"], r["verdict"]) for r in got} == {a: (w[0], w[2], w[4]) for a, w in want.items()}
    rng = np.random.default_rng(1)
    for r in got:
        assert (r["rate"], r["spread"]) == (pytest.approx(want[r["arm"]][1]), pytest.approx(want[r["arm"]][3]))
        if r["blind_rate"] is not None:
            assert ends[r["arm"]] == pytest.approx(plain_ends(cells, r["arm"], r["attacker"], rng), abs=0.004)
    if panel == "rules":
        assert {r["arm"]: r["verdict"].split(":")[0] for r in got} == {"same": "INCONCLUSIVE", "worse": "FAIL", "apart": "INCONCLUSIVE", "few": "INCONCLUSIVE", "leaky": "FAIL", "gone": "PASS"}


def test_dealing_by_classes_equals_dealing_units():
    rng = np.random.default_rng(3)
    # Six kinds of units, of which there are many, and truths of which one is unknown.
    answers = [{0: 2}, {1: 1, 0: 1}, {2: 3}, {}, {1: 2}, {3: 1}]
    units, truths, margin = np.array([40, 30, 20, 10, 25, 15]), np.array([0, 1, 2, -1]), np.array([60, 40, 30, 10])
    got = evaluation.dealt_rates(truths, margin, answers, units, 6000, [1, 0])
    row, dealt = np.repeat(np.arange(6), units), np.repeat(truths, margin)
    total = sum(n * sum(a.values()) for a, n in zip(answers, units, strict=True))
    want = np.array([sum(answers[r].get(t, 0) for r, t in zip(row.tolist(), rng.permutation(dealt).tolist(), strict=True)) / total for _ in range(1500)])
    assert abs(got.mean() - want.mean()) < 0.004 and abs(got.std() - want.std()) < 0.003
    assert np.abs(np.quantile(got, [0.025, 0.5, 0.975]) - np.quantile(want, [0.025, 0.5, 0.975])).max() < 0.015


def test_a_cell_of_many_units_is_few_classes(spark):
    import time

    n = 2_000_000
    items = spark.range(n).select(F.lit("a").alias("arm"), F.col("id").alias("file"), (F.col("id") % 4).alias("truth"), F.when(F.col("id") % 3 == 0, F.col("id") % 4).otherwise(F.xxhash64("id") % 4).alias("answer"))
    began = time.time()
    r = evaluation.permutation_null(items, ["arm"], "file", "truth", "answer", draws=1000).first()
    assert r["observed"] > 0.3 and abs(r["null_mean"] - r["observed"]) > 0.05 and r["high"] - r["low"] < 0.01 and r["p"] == pytest.approx(1 / 1001)
    assert time.time() - began < 120


def test_association_is_refused_for_the_first_reason(spark):
    detections = spark.createDataFrame([("d1", "c", "s1", 10.0, None), ("d2", "c", "s2", 10.0, ""), ("d3", "c", "s1", 0.0, None), ("d4", "c", "s2", 10.0, "EVT-000001")], "detection_id string, channel_id string, station_id string, amplitude double, event_id string")
    stations = spark.createDataFrame([("s1", 0.0, 0.0), ("s2", 0.0, 1.0)], "station_id string, latitude double, longitude double")
    t = "2024-05-01T10:00:00+02:00"
    requests = spark.createDataFrame([(1, t, ["d1"]), (2, "soon", ["d1", "d2"]), (3, t, ["d1", "d9"]), (4, t, ["d1", "d4"]), (5, t, ["d1", "d3"]), (6, t, ["d2", "d3"])], "request int, origin_time string, detection_ids array<string>")
    place = lambda df: df.withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0), "depth_km": F.lit(1.0)})
    got = associate.associate(place(requests.where("request < 5")), detections, stations, 1)
    assert {r["request"]: r["reason"] for r in got.refused.collect()} == {1: "at least two detections are required", 2: "origin time must be RFC 3339", 3: "not found", 4: "already associated"}
    assert {r["reason"] for r in associate.associate(place(requests.where("request = 5")), detections, stations, 1).refused.collect()} == {"detections must span two stations"}
    done = associate.associate(place(requests.where("request = 6")), detections, stations, 1)
    event = done.events.first()
    assert (event["event_id"], event["detection_count"]) == ("EVT-000002", 2) and done.refused.count() == 0
    # One degree away, and at the station without amplitude.
    want = (np.log10(10) + 3 * np.log10(111.19492664455873) - 2.92 + np.log10(1e-9) + 0 - 2.92) / 2
    assert event["magnitude"] == pytest.approx(want) and {r["detection_id"]: r["event_id"] for r in done.detections.collect()} == {"d1": None, "d2": "EVT-000002", "d3": "EVT-000002", "d4": "EVT-000001"}


def test_malformed_catalogue_records(spark):
    texts = ["", "=24", "no tag", "=245  10", "=245  10$", "=876  \\\\$aitem\n=583  \\\\$aLOANSTART$bD8", "=260  \\\\$c2020.\n=260  \\\\$c20210101.\n=852  \\\\$i only", None]
    df = formats.tagged_records(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = [r["h"] for r in df.select(formats.holding(F.col("fields")).alias("h")).collect()]
    assert [h["title"] for h in got[:5]] == [""] * 5 and got[5]["loans"][0]["effective_start"] == ""
    assert (got[6]["published"], got[6]["call_number"]) == ("2021-01-01", "only")


def test_malformed_blocks(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["LAT 1", "STA", "STA A\r", "LAT north", "EPOCH", "CHAN B", "EPOCH 1", "END", "CHAN C", "EPOCH 2"])], "file string, n int, line string")
    heads, channels = formats.stations(lines)
    assert sorted((r["station_id"], r["latitude"]) for r in heads.collect()) == [("", None), ("A", None)]
    assert sorted((r["channel_id"], r["start"], r["end"]) for r in channels.collect()) == [("A-1", "", None), ("A-B-1", "1", None)]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["COMPLIANCE", "DONE x", "COMPLIANCE D1", "DIRECTIVE D", "APPLIES-SERIAL 5", "APPLIES-KIND x", "INTERVAL-DAYS soon"])], "file string, n int, line string")
    got = formats.maintenance(lines)
    assert sorted((r["directive_id"] or "", r["component_id"]) for r in got["compliance"].collect()) == [("", None), ("D1", None)]
    assert [tuple(r) for r in got["applicability"].collect()] == [("D", "SERIAL_RANGE", None, "5", "")] and got["directive"].first()["interval_days"] is None


def test_literal_rows_equal_a_plain_walk(spark, sf):
    got = sorted(tuple(r) for r in plans.queries()["e02_literal_rows"](spark, sf).collect())
    want = sorted((i, k, a, z, q) for i, text in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall() for k, (a, z, q) in enumerate(plain_literals(text)))
    assert got == want and got


def test_arms_and_trees(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x = "a b"')], "d int, text string")
    got = {r["arm"]: r["output"] for r in registry.arms(df, ["source", "blind", "tag-literals", "pseudonymise", "composed"], "d", "tsx", bytes(16)).collect()}
    assert got["source"] == 'x = "a b"' and got["blind"].startswith("STRUCTURAL PROFILE") and got["tag-literals"] == 'x = "<MSG:0>"'
    with pytest.raises(KeyError, match="unknown transform"):
        registry.arms(df, ["other"], "d", "tsx", bytes(16))
    (tmp_path / "a.go").write_text("package a\n")
    (tmp_path / "a_test.go").write_text("package a\n")
    r = registry.transform_tree(spark, str(tmp_path), "reverse-text", "go", "radio").collect()
    assert [(x["target"], x["output"], x["error"], x["delta"]["lines"]) for x in r] == [("radio", "\na egakcap", None, 1)]


def test_model_names(spark):
    from larkspur.functions import catalogue

    df = spark.createDataFrame([("mixtral-8x7B",), ("qwen3-30b-a3b",), ("llama-3.1-70b",), ("gpt",), ("x-7bit",), ("KNOWN/one",)], "m string")
    assert [r[0] for r in df.select(catalogue.billions(F.col("m"), {"known/one": 5})).collect()] == [56.0, 30.0, 70.0, None, None, 5.0]
    assert catalogue.term_pattern([]) == "(?!)" and catalogue.term_pattern(["c++", "a b"], ["A B"]).count("a b") == 1


def test_keyed_digests_and_days(spark):
    import hmac

    for key in (b"k", bytes(64), bytes(range(100))):
        got = spark.createDataFrame([("",), ("naïve 😀",), (None,)], "t string").select("t", stats.hmac_sha256(key, F.col("t")).alias("h")).collect()
        assert [r["h"] for r in got] == [None if r["t"] is None else hmac.new(key, r["t"].encode(), "sha256").hexdigest() for r in got]
    days = {"2024-02-28": 2, "2024-03-01": 0, "2024-03-05": -4, "2024-02-30": 0, "1 March": 0, "": 0, None: 0, "2024-2-3": 0}
    got = spark.createDataFrame([(d,) for d in days], "d string").select("d", stats.days_since(F.col("d"), F.lit("2024-03-01").cast("date")).alias("n")).collect()
    assert {r["d"]: r["n"] for r in got} == days


def test_remaining_life_equals_the_plain_rule(spark):
    def plain(used, most):
        best, unit, left = -1.0, None, []
        for name, u, m in zip(("HOURS", "CYCLES", "CALENDAR_DAYS"), used, most, strict=True):
            left.append(m - u if m and m > 0 else None)
            if m and m > 0 and u / m > best:
                best, unit = u / m, name
        return (*left, unit)

    rng = random.Random(1)
    rows = [([rng.randrange(9) / 2, rng.randrange(9), rng.randrange(9)], [rng.choice([None, 0.0, 4.0]), rng.choice([None, 0, 4, 8]), rng.choice([None, -1, 4])]) for _ in range(200)]
    df = spark.createDataFrame([(i, *u, *m) for i, (u, m) in enumerate(rows)], "i int, a double, b long, c long, x double, y long, z long")
    got = df.select("i", stats.remaining_life(*[F.col(c) for c in "abcxyz"]).alias("l")).collect()
    assert all(tuple(r["l"]) == plain(*rows[r["i"]]) for r in got)


def test_texts_are_taken_in_parts_of_bounded_size():
    import pandas as pd

    from larkspur.functions import batches

    texts = pd.Series(["x" * 1000] * 5000 + [None, "", "y" * 3_000_000, "z"])
    seen = []

    def run(some):
        seen.append((len(some), sum(len(t or "") for t in some)))
        return some

    out = pd.concat(list(batches.in_parts(run)(iter([texts]))))
    assert list(out) == list(texts) and max(n for _, n in seen) <= 3_000_000 + batches.PART_CHARS and len(seen) >= 5
    two = list(batches.in_parts(lambda a, b: a + b)(iter([(pd.Series(["a", "b"]), pd.Series(["c", "d"]))])))
    assert list(pd.concat(two)) == ["ac", "bd"]


@pytest.mark.parametrize("make", ["cut", "checked", "pseudonymise"])
def test_functions_of_texts_give_a_part_at_a_time(spark, monkeypatch, make):
    import pandas as pd
    from pyspark.sql import functions

    from larkspur.functions import literals

    caught = []
    monkeypatch.setattr(functions, "pandas_udf", lambda f, kind: caught.append(f) or (lambda *c: None))
    {"cut": lambda: literals.cut_at_literals(None), "checked": lambda: identifiers.checked(None, bytes(16)), "pseudonymise": lambda: identifiers.pseudonymise(None, bytes(16))}[make]()
    frames = list(caught[0](iter([pd.Series([f'word "lit" other{i} ' * 1000 for i in range(300)])])))
    assert sum(map(len, frames)) == 300 and max(map(len, frames)) <= 100


def test_holdings_are_read_by_many_tasks(spark, sf):
    plan = plans.queries()["s11_holdings"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
