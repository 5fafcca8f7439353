import json

import pytest
from pyspark.sql import functions as F

from studylake.operators import search
from studylake.sources import files


def test_files_are_streamed_in_order_and_listed(spark, tmp_path):
    rows = [(f"{n} é.md", k, None if k == 3 else f"line {k} of {n}\nmore") for n in range(20) for k in range(6)]
    df = spark.createDataFrame(rows, "filename string, k int, body string").repartition(5, "k")
    path = str(tmp_path / "out")
    files.write_files(df, path, ["k"])
    want = {f"{n} é.md": "\n".join(f"line {k} of {n}\nmore" for k in range(6) if k != 3) for n in range(20)}
    assert {p.name: p.read_text() for p in (tmp_path / "out").glob("*.md")} == want
    manifest = json.loads((tmp_path / "out" / files.MANIFEST).read_text())
    assert manifest["count"] == 20 and manifest["bytes"] == sum(len(t.encode()) for t in want.values())
    assert {r.filename: r.body for r in files.read_files(spark, path).collect()} == want


def test_a_failed_task_leaves_no_manifest_and_no_files_of_others(spark, tmp_path):
    path = str(tmp_path / "out")
    body = F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string"))
    df = spark.range(100).select(F.format_string("f%d.txt", "id").alias("filename"), body.alias("body"))
    with pytest.raises(Exception):
        files.write_files(df, path)
    assert not (tmp_path / "out" / files.MANIFEST).exists()
    files.write_files(df.where("filename <> 'f77.txt'"), path)
    assert files.read_files(spark, path).count() == 99


def test_no_rows(spark, tmp_path):
    files.write_files(spark.createDataFrame([], "filename string, body string"), str(tmp_path / "out"))
    assert files.read_files(spark, str(tmp_path / "out")).collect() == []


def test_snippets_equal_those_of_the_function(spark):
    texts = [None, "", "...", "The end", "x " * 50 + "the of", "of " + "y " * 40 + "the and the of" + " z" * 60, "the " * 100, "a-the, of; " * 30, "É the ÜÄ_x of " * 9, "the" + " q" * 23 + " of and" + " r" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    terms = ["the", "of", "and", "é"]
    both = df.select("id", search.snippet_column(F.col("t"), terms).alias("a"), search.snippet(F.col("t"), F.array(*map(F.lit, terms))).alias("b")).collect()
    assert all((r.a or "") == (r.b or "") for r in both) and sum(r.a is not None for r in both) == 7
    short = df.select("id", search.snippet_column(F.col("t"), terms, 3).alias("a"), search.snippet(F.col("t"), F.array(*map(F.lit, terms)), 3).alias("b")).collect()
    assert all((r.a or "") == (r.b or "") for r in short)
