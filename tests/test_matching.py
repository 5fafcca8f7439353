"""Anchors, branches, jobs and exports against plain computations."""

import base64
import random
import re

import pytest
from pyspark.sql import functions as F

from studylake.operators import anchors, context, exports

WORDS = "the of and rare odd long small tree house river green stone".split()


def word_set(text):
    return {w for w in re.split(r"\W+", text.lower()) if w}


def blocks_of(spark, seed):
    rng = random.Random(seed)
    texts = [(d, o, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))) for d in range(8) for o in range(6)]
    return texts, spark.createDataFrame([(d, o, t, 100 * o) for d, o, t in texts], "doc_id long, ordinal long, text string, start long")


@pytest.mark.parametrize("limit", [4 << 20, 20])
def test_short_quotes_are_found_by_automata(spark, limit):
    texts, blocks = blocks_of(spark, 1)
    quotes = [(i, q) for i, q in enumerate(["a", "ee", "the", "e o", "tree house", "nowhere", "the", "of the", ".", "é"])]
    found = anchors.scanned(spark.createDataFrame(quotes, "id long, exact string"), blocks, ["doc_id"], limit)
    assert sorted(map(tuple, found.collect())) == sorted((i, d, o) for i, q in quotes for d, o, t in texts if q in t)


def test_no_nested_loop_for_any_quote(spark):
    _, blocks = blocks_of(spark, 2)
    quotes = spark.createDataFrame([(1, "the"), (2, "of the"), (3, "rare odd long small tree")], "anchor_id long, exact string")
    plan = anchors.candidates(quotes, blocks, ["doc_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("on", [["doc_id"], []])
def test_fuzzy_matches_equal_comparing_all(spark, on):
    texts, blocks = blocks_of(spark, 3)
    rng = random.Random(4)
    asked = []
    for i in range(40):
        d, o, t = rng.choice(texts)
        words = t.split()
        rng.shuffle(words)
        asked.append((i, " ".join(words[: rng.randint(0, 9)] + rng.choices(["new", "the", "words"], k=rng.randint(0, 4))), d))
    df = spark.createDataFrame(asked, "anchor_id long, exact string, doc_id long")
    got = {r.anchor_id: (r.doc_id, r.ordinal, r.score, r.status) for r in anchors.fuzzy_matches(df if on else df.drop("doc_id"), blocks, on, [] if on else ["doc_id"]).join(df.select("anchor_id", F.col("doc_id").alias("own")), "anchor_id").withColumn("doc_id", F.lit(None) if on else F.col("doc_id")).collect()}
    want = {}
    for i, q, d in asked:
        a = word_set(q)
        scored = []
        for bd, o, t in texts:
            b = word_set(t)
            if a & b and (not on or bd == d):
                scored.append((-(1.0 if t == q else round(len(a & b) / max(len(a), len(b)), 9)), bd, o))
        if scored:
            s, bd, o = min(scored)
            want[i] = (None if on else bd, o, -s, "attached" if -s >= anchors.FUZZY else "unmatched")
    assert got == want and {w[3] for w in want.values()} == {"attached", "unmatched"}


def test_branches_of_any_depth(spark):
    rng = random.Random(5)
    threads = [(i, None if i == 0 else 1000 + rng.randrange(max(0, i - 3), i)) for i in range(60)] + [(100, 1101), (101, 1100)]  # two in a cycle
    messages = [(1000 + i, i, f"2024-01-01 00:00:{i % 60:02d}") for i, _ in threads]
    t = spark.createDataFrame(threads, "thread_id long, parent_message_id long")
    m = spark.createDataFrame(messages, "message_id long, thread_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    parent = dict(threads)
    for limit in (1, 2, 5, 32):
        want = set()
        for leaf in parent:
            at, depth, cut = leaf, 0, None
            while at is not None and depth < limit:
                want.add((leaf, depth, at, cut))
                up = parent[at]
                cut = None if up is None else f"{(up - 1000) % 60:02d}"
                at, depth = None if up is None else up - 1000, depth + 1
        rows = context.active_branch(t, m, limit).collect()
        assert len(rows) == len(want) and {(r.leaf_id, r.depth, r.thread_id, None if r.cutoff is None else f"{r.cutoff.second:02d}") for r in rows} == want


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_job_moves_fold_in_order(spark, size):
    rng = random.Random(6)
    moves = [(rng.randrange(12), n, rng.choice(["queue", "start", "result", "fail", "cancel", "text_changed", "nonsense", None])) for n in range(400)]
    df = spark.createDataFrame(moves, "job long, n long, move string")
    got = {r.job: (r.status, r.errors, r.n_moves) for r in context.job_states(df, "job", "n", "move", F.floor(F.col("n") / size)).collect()}
    want = {}
    for job, _, move in moves:
        state, errors, n = want.get(job, ("none", 0, 0))
        now = context.MOVES.get((state, move))
        want[job] = (now or state, errors + (now is None), n + 1)
    assert got == want


def test_assets_in_style_sheets_and_under_similar_names(spark):
    pages = spark.createDataFrame([(1, "<img asset:a1><img asset:a10><link asset:s1><x asset:gone> asset:a1"), (2, "plain"), (3, None)], "id long, html string")
    rows = [(1, "a1", "image/png", b"one"), (1, "a10", "image/png", b"ten"), (1, "s1", "text/css", b"p{url(asset:a10)} @import asset:s0"), (1, "s0", "text/css", b"asset:a1 asset:s1")]
    assets = spark.createDataFrame([(i, a, m, bytearray(c)) for i, a, m, c in rows], "id long, asset_id string, mime string, content binary")
    uri = lambda mime, body: f"data:{mime};base64," + base64.b64encode(body).decode()
    one, ten = uri("image/png", b"one"), uri("image/png", b"ten")
    s0 = uri("text/css", f"{one} asset:s1".encode())
    s1 = uri("text/css", f"p{{url({ten})}} @import {s0}".encode())
    got = {r.id: r.html for r in exports.embed_assets(pages, assets, "id", "html").collect()}
    assert got == {1: f"<img {one}><img {ten}><link {s1}><x asset:gone> {one}", 2: "plain", 3: None}


def test_exports_show_the_edited_page(spark):
    documents = spark.createDataFrame([(1, "t"), (2, "u")], "document_id long, title string")
    versions = spark.createDataFrame([(1, 1, "v1", "old", "<p>old"), (1, 2, "v2", "as it came", "<p>as it came<script>x</script>"), (2, 1, "v3", "kept", "<p>kept")], "document_id long, version long, version_id string, canonical_text string, html string")
    edits = spark.createDataFrame([("v2", 1, "first"), ("v2", 2, "<p>edited<script>y</script>"), ("v1", 9, "no")], "version_id string, revision long, html string")
    none = spark.createDataFrame([], "version_id string, checked boolean, start_offset long, exact_quote string, note string, document_id long, promoted boolean, created_at timestamp, kind string, content string")
    out = {r.document_id: (r.html, r.canonical_text) for r in exports.export_data(documents, versions, none, none.drop("version_id"), revisions=edits).collect()}
    assert out == {1: ("<p>edited", "as it came"), 2: ("<p>kept", "kept")}
