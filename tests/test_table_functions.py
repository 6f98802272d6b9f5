"""Partitioned table functions over files of lines, in SQL."""

from __future__ import annotations

import pytest

from larkspur.sources import table_functions


@pytest.fixture
def view(spark, tmp_path):
    table_functions.register(spark)

    def make(files):
        for name, text in files.items():
            (tmp_path / name).write_text(text)
        table_functions.text_lines(spark, str(tmp_path)).repartition(3).createOrReplaceTempView("lines_of_files")
        return lambda f: [tuple(r) for r in spark.sql(f"SELECT * FROM {f}(TABLE(SELECT file, n, line FROM lines_of_files) PARTITION BY file ORDER BY n)").collect()]

    return make


def test_shift_lines_from_files(view):
    a = "RUN: 7\nSTATUS: open\nDEFECT: SNAG SEV2 AT 3.5M NOTE=a long\n  note of it\nDEFECT: TEAR SEV1 AT 4M\n\n\nRUN: 8\nRUN: 9\nDEFECT: odd one\n"
    got = view({"a.txt": a, "b.txt": "STATUS: done\n", "c.txt": "\n\n"})("shift_lines")
    rows = sorted((r[0].rpartition("/")[2], *r[1:]) for r in got if r[2] != "8")
    assert [r for r in rows if r[0] == "a.txt"] == [("a.txt", 0, "7", "open", "SNAG", 2, 3.5, "a long note of it"), ("a.txt", 0, "7", "open", "TEAR", 1, 4.0, None)]
    assert [r[1:] for r in rows if r[0] == "b.txt"] == [(0, None, "done", None, None, None, None)] and len(got) == 4
    assert [r[1:] for r in got if r[2] == "8"] == [(1, "8", None, None, None, None, None)]


def test_log_lines_keep_what_stations_declare(view):
    tag = lambda **f: "".join(f"<{k}:{len(v)}>{v}" for k, v in f.items()) + "<fin>"
    contact = {"wk": "K1", "bnd": "20m", "mode": "CW", "qdate": "20240131", "qtime": "1201"}
    a = [
        tag(op="N0", sgrid="AB12"), tag(op="N0", **contact), tag(op="N0", scls="B", sgrid="ZZ", **contact), tag(op="M5", **contact), tag(op="N0", **contact | {"qdate": "today"}),
        tag(op="N0", wk="K1"), "<op:2>N0<bad><wk:²>K1<sgrid:x>", "", tag(**contact), "<op:2>N0<scls:9>C",
    ]
    got = view({"a.log": "\n".join(a), "b.log": tag(op="N0", **contact)})("log_lines")
    rows = [(r[0].rpartition("/")[2][0], *r[1:]) for r in got]
    rest = ("K1", "20m", "CW", "2024-01-31", "1201")
    assert sorted(rows, key=str) == sorted([("a", "N0", "AB12", None, *rest), ("a", "N0", "ZZ", "B", *rest), ("a", "M5", None, None, *rest), ("a", "N0", "ZZ", "B", *rest[:3], "today", "1201"), ("b", "N0", None, None, *rest)], key=str)


def test_lines_of_a_file_keep_their_order(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"{i} {'x' * 50}\n" for i in range(20_000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = table_functions.text_lines(spark, str(tmp_path)).orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [int(r["line"].split()[0]) for r in got] == list(range(20_000))
