"""Line dedup against a plain dictionary."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from oracle_check import compare
from tickframe.llm import line_dedup

SF = "/root/testdata/sf0.001"


def plain(rows, least=10):
    def key(line):
        s = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return re.sub("[A-Z]", lambda m: m[0].lower(), s)
    first = {}
    for d, t in rows:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= least and d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or first.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(4, "A shared long line\n  a SHARED long line\t\nown words of four"), (1, "a shared long line\n\nshort\n"),
        (2, None), (3, ""), (None, "a shared long line"), (7, "short\nÉcole à la ligne\n"), (8, "école à la ligne\x0b\nÉcole à la ligne"),
        (9, "own words of four\nA shared long line"), (9, "own words of four\nA shared long line"), (10, "ten points"), (11, "ten points"),
        (12, "nine char\nnine char"), (13, "nine char"), (14, "\n".join(f"line number {i % 40}" for i in range(200))),
        (15, "line number 3\nother\n" * 30)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (5, 3), (9, 2)])
def test_rows_equal_plain(spark, batches, fanout):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = line_dedup.line_digest(df, batches=batches, fanout=fanout)
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS)


def test_columns_are_carried_and_clashes_replaced(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_dropped", F.lit("x")).withColumn("lang", F.lit("en"))
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "lang", "text", "n_lines", "n_dropped"]
    assert got.filter("doc_id = 4").first().text == "own words of four"
    assert got.count() == len(ROWS)


def test_empty_table(spark):
    assert line_dedup.line_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_sql(spark):
    assert "op10_line_dedup" in E.oracle_sql()
    assert compare(spark, SF, ["op10_line_dedup"], verbose=False) == []


def test_no_run_stays_in_the_catalog(spark):
    got = line_dedup.dedup_lines(spark.createDataFrame(ROWS, "doc_id long, text string"), batches=3)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")]
    assert got.count() == len(ROWS)
