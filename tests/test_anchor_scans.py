"""Quotes compared with all blocks in one pass or several, and what it must not read twice."""

import random
import re

import pytest
from pyspark.sql import functions as F

from studylake.functions import text as tx
from studylake.operators import anchors, blocks


def word_set(text):
    return {w for w in re.split(r"\W+", text.lower()) if w}


@pytest.mark.parametrize("limit", [1 << 14, 12])
@pytest.mark.parametrize("cells", [1 << 21, 7])
def test_every_quote_gets_its_best_block(spark, limit, cells):
    rng = random.Random(limit + cells)
    words = "the of and rare odd long small tree house river green stone".split()
    texts = [(d, o, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for d in range(30) for o in range(5)] + [(90, 0, None), (91, 0, "---")]
    asked = [(i, " ".join(rng.choices([*words, "new", "odd"], k=rng.randint(0, 8)))) for i in range(25)] + [(30, texts[0][2]), (31, "---"), (32, None), (33, "nowhere")]
    q = spark.createDataFrame(asked, "anchor_id long, exact string").withColumn("ws", tx.word_set(F.col("exact")))
    b = spark.createDataFrame([(d, o, t, 10 * o) for d, o, t in texts], "doc_id long, ordinal long, text string, start long").repartition(3)
    got = {r.anchor_id: (-r.m.doc_id, -r.m.ordinal, r.m.score) for r in anchors.compared(q, b, ["doc_id"], limit, cells).collect()}
    want = {}
    for i, text in asked:
        a = word_set(text or "")
        scored = [(-(1.0 if t == text else round(len(a & word_set(t)) / max(len(a), len(word_set(t))), 9)), d, o) for d, o, t in texts if t and a & word_set(t)]
        if scored:
            want[i] = (*min(scored)[1:], -min(scored)[0])
    assert got == want
    both = anchors.fuzzy_matches(q.select("anchor_id", "exact"), b, [], ["doc_id"], few=limit)
    assert {r.anchor_id: (r.doc_id, r.ordinal, r.score) for r in both.collect()} == want


def test_few_quotes_shuffle_no_texts(spark):
    b = blocks.placed_lines(spark.createDataFrame([(1, "the quick brown fox\njumps"), (2, None)], "doc_id long, text string"))
    a = spark.createDataFrame([(1, "quick brown fox leaps", "", "", 0), (2, "jumps", "", "", 0)], "anchor_id long, exact string, prefix string, suffix string, anchor_start long")
    for found in (anchors.fuzzy_matches(a, b, [], ["doc_id"]), anchors.exact_matches(a, b, [], ["doc_id"])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("split(text") == 1 and len(found.collect()) == (2 if "0.62" in plan else 1)
    assert b.count() == 2


def test_quotes_of_a_version_meet_its_blocks_once(spark):
    b = blocks.placed_lines(spark.createDataFrame([(1, "the quick brown fox\njumps")], "doc_id long, text string"))
    a = spark.createDataFrame([(1, 1, "quick brown fox leaps")], "anchor_id long, doc_id long, exact string")
    plan = anchors.fuzzy_matches(a, b, ["doc_id"], [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("split(text") == 1


def test_white_space_collapses(spark):
    rng = random.Random(6)
    blank = " \t\n\x0b\x0c\r\xa0     　﻿"
    texts = ["".join(rng.choices("ab é\x7f  " + blank, k=rng.randint(0, 12))) for _ in range(400)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(tx.collapse(F.col("t"))).collect()]
    assert got == [re.sub(f"[{blank}]+", " ", t).strip(" ") for t in texts]
