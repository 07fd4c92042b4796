"""Splits of files with line breaks inside quotes against the reading in one task."""

import csv
import random

import pytest

from clientela.sources.quoted_csv import quoted_records, read_quoted_csv


def write(path, rows, newline="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator=newline).writerows(rows)


def some_rows(n, seed):
    rng = random.Random(seed)
    parts = ["good", "a,b", 'he said "no"', "two\nlines", "\n", "three\n\nlines\n", "", '"', "é😀", " x "]
    return [(f"id{i}", rng.randrange(6), "".join(rng.choice(parts) for _ in range(rng.randrange(6))), f"end{i}")
            for i in range(n)]


def same(spark, path):
    whole = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    found = read_quoted_csv(spark, path)
    assert found.columns == whole.columns
    order = [tuple(x or "" for x in r) for r in whole.collect()]
    assert sorted(tuple(x or "" for x in r) for r in found.collect()) == sorted(order)
    return len(order)


@pytest.mark.parametrize("split", ["300", "2000", "128m"])
def test_splits_equal_the_reading_in_one_task(spark, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = tmp_path / "reviews.csv"
        write(path, [("review_id", "score", "comment", "tail"), *some_rows(300, 1)])
        splits = spark.read.text(str(path)).rdd.getNumPartitions()
        assert splits >= 4 or split == "128m"
        assert same(spark, str(path)) == 300
        numbers = sorted(r["record"] for r in quoted_records(spark, str(path)).collect())
        assert numbers == list(range(1, 302))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_folders_windows_line_ends_and_blank_lines(spark, tmp_path):
    folder = tmp_path / "reviews"
    folder.mkdir()
    header = ("review_id", "score", "comment", "tail")
    for i in range(3):
        write(folder / f"part{i}.csv", [header, *some_rows(40, i + 5)])
    assert same(spark, str(folder)) == 120
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'a,b\r\n1,"x\ny"\r\n\r\n2,z\r\n')
    assert [tuple(r) for r in read_quoted_csv(spark, str(path)).orderBy("a").collect()] == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "only.csv").write_text("a,b\n")
    only = read_quoted_csv(spark, str(tmp_path / "only.csv"))
    assert only.columns == ["a", "b"] and only.collect() == []


def test_lines_with_whole_records_are_not_shuffled(spark, tmp_path):
    path = tmp_path / "plain.csv"
    write(path, [("a", "b"), *[(f"x{i}", 'in "quotes"') for i in range(50)]])
    stored = quoted_records(spark, str(path))
    rows = stored.collect()
    assert sorted(r["record"] for r in rows) == list(range(1, 52))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" in plan  # for records with breaks alone
    broken = path.read_text() + 'y,"two\nlines"\n'
    path.write_text(broken)
    assert same(spark, str(path)) == 51
    windows = plan.count("Window")
    assert windows == 0
