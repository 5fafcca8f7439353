import hashlib
import re

import pytest
from pyspark.sql import functions as F

from studylake.llm import fill_in_middle as fim


def plainly(doc_id, text, unit=r"(?s:.)", seed=1):
    """The same by slicing a list of units."""
    text = text or ""
    units = re.findall(unit, text, re.ASCII)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    return "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "ab", "é ü😀x", "a <P> b", "<S", "x<", "<M>", "\n\r\n \t", "tail< >", "z" * 511, "y" * 512, "x" * 513, "word and space " * 400, "😀é" * 3000]
SCHEMA = "doc_id long, text string, output string, id string, key string, form string, stretch int"


def given(spark):
    rows = [(i, t, "o", "i", "k", "f", 1) for i, t in enumerate(TEXTS * 3)]
    return rows + [rows[4], rows[15], rows[15], (None, "no id here", "o", "i", "k", "f", 1), (None, None, "o", "i", "k", "f", 1)]


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\S+\s*|\s+"])
def test_equals_slicing_of_units(spark, unit):
    rows = given(spark)
    out = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA), unit=unit)
    got = [(r["id"], r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *plainly(r[0], r[1], unit.replace("(?s:.)", r"[\s\S]"))) for r in rows), key=repr)
    assert {g[1] for g in got} == {"plain", "psm", "spm"}


def test_restores_every_text(spark):
    out = fim.fill_in_middle(spark.createDataFrame(given(spark), SCHEMA)).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert sorted((r["id"] if r["id"] is not None else -1, r.back) for r in out.collect()) == sorted((r[0] if r[0] is not None else -1, r[1] or "") for r in given(spark))


def test_parts_may_end_like_marks(spark):
    rows = [(i, "<S><P>M><"[i % 5 + 1 :] * 3 + "<" * (i % 3), *[None] * 5) for i in range(60)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA)).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert {r["id"]: r.back for r in out.collect()} == {r[0]: r[1] for r in rows}


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
