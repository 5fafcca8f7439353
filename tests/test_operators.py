import datetime as dt

import pytest
from pyspark.sql import functions as F

from studylake.operators import anchors, artifacts, blocks, context, edits, exports, routing, search, store, templates
from studylake.streaming import events as ev


def test_exact_match_takes_context_and_overlaps(spark):
    quote = spark.createDataFrame([(1, 7, "fox", "brown ", " runs", 0), (2, 7, "nothing shared here", "", "", 0), (3, 7, "aa", "", "", 3), (4, 7, "", "", "", 0)], "anchor_id long, v long, exact string, prefix string, suffix string, anchor_start long")
    text = spark.createDataFrame([(7, 0, "the red fox sits", 0), (7, 1, "a brown fox runs", 18), (7, 2, "aaaa", 36), (8, 0, "brown fox runs", 0)], "v long, ordinal long, text string, start long")
    got = {r.anchor_id: r for r in anchors.reattach(quote, text, ["v"]).collect()}
    assert (got[1].ordinal, got[1].start_offset, got[1].status) == (1, 26, "attached")
    assert got[2].status == got[4].status == "unmatched" and got[3].start_offset == 36
    df = spark.createDataFrame([("aaaa", "aa"), ("abcabc", "abc"), ("x", "xx"), ("x", "")], "t string, q string")
    assert [r[0] for r in df.select(anchors.occurrences(F.col("t"), F.col("q"))).collect()] == [[0, 1, 2], [0, 3], [], []]


def test_unchanged_blocks_stay_attached_and_migrate(spark):
    text = spark.createDataFrame([(2, 0, "New heading", 0), (2, 1, "quoted words stand here", 13)], "v long, ordinal long, text string, start long")
    old = spark.createDataFrame([(1, 2, "quoted words", "", " stand", 0)], "anchor_id long, v long, exact string, prefix string, suffix string, anchor_start long")
    marks = spark.createDataFrame([(5, 1, True)], "highlight_id long, anchor_id long, checked boolean")
    placed = anchors.reattach(old, text, ["v"])
    moved, copies = anchors.migrate(old, marks, placed, F.lit(2))
    row, copy = moved.first(), copies.first()
    assert row.status == "attached" and row.start_offset == 13 and row.migrated_from_id == 1 and copy.anchor_id == row.anchor_id and copy.checked


def test_repair(spark):
    placed = spark.createDataFrame([(1, None, None, None, "unmatched", 0.0)], "anchor_id long, ordinal long, start_offset long, end_offset long, status string, score double")
    fix = spark.createDataFrame([(1, 7, 1, 2, 5)], "anchor_id long, v long, ordinal long, local_start long, local_end long")
    text = spark.createDataFrame([(7, 1, 18)], "v long, ordinal long, start long")
    assert tuple(anchors.repair(placed, fix, text, "v").first())[1:5] == (1, 20, 23, "attached")


def test_empty_blocks_keep_their_gap(spark):
    docs = spark.createDataFrame([(1, "ab\n\ncd")], "doc_id long, text string")
    rows = blocks.with_offsets(blocks.line_blocks(docs), "doc_id").orderBy("ordinal").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 2), (4, 4), (6, 8)]
    assert blocks.canonical_text(blocks.line_blocks(docs), "doc_id").first().canonical_text == "ab\n\ncd"


REQUESTS = [
    ("a", "define", "entropy", False, False, 10, None, None), ("b", "ask", "why? how?", False, False, 10, None, None), ("c", "ask", "x" * 241, False, False, 10, None, None),
    ("d", "ask", "look", True, False, 10, None, None), ("e", "explain", "e", False, False, 9500, None, None), ("f", "explain", "e", False, False, 10, "big", None),
    ("g", "explain", "e", True, False, 10, "small", None), ("h", "ask", "x" * 121, False, False, 10, None, None), ("i", "visualize", "v", False, False, 10, None, None),
]


def test_routing(spark):
    requests = spark.createDataFrame(REQUESTS, "id string, " + routing.REQUEST)
    able = "struct<text:boolean,vision:boolean,structuredOutput:boolean,functionTools:boolean,providerWebSearch:boolean,reasoningControl:boolean,imageGeneration:boolean,streaming:boolean>"
    model = lambda i, window, eyes, rank: (i, "p", window, 1000, rank, True, (True, eyes, False, False, False, False, False, True))
    models = spark.createDataFrame([model("small", 10000, False, 1), model("big", 128000, True, 2), model("slow", 10000, False, 1)], f"id string, provider_id string, context_window long, max_output long, priority long, enabled boolean, capabilities {able}")
    profiles = spark.createDataFrame([(p, ["small", "big", "slow"]) for p in ("quick", "standard", "deep", "vision", "digest")], "name string, model_ids array<string>")
    latency = spark.createDataFrame([("small", 50.0)], "model_id string, ttft double")
    got = {r.id: (r.profile, r.model_id, r.reason or r.error) for r in routing.route(requests, ["id"], models, profiles, latency).collect()}
    assert got["a"] == ("quick", "small", "deterministic quick rule") and got["b"][0] == got["c"][0] == "deep"
    assert got["d"][:2] == ("vision", "big") and got["e"][:2] == ("standard", "big") and got["f"] == ("standard", "big", "manual override")
    assert got["g"] == ("vision", None, "named model cannot serve the request") and got["h"] == ("deep", "small", "freeform deterministic fallback")
    assert got["i"] == ("digest", None, "no capable digest model")


def test_context_settings_branch_and_digest(spark):
    assert not context.Settings().problems()
    assert len(context.Settings(quick_context_max_tokens=100, study_context_percent=10).problems()) == 2
    stamp = lambda n: dt.datetime(2024, 1, 1, 0, n)
    threads = spark.createDataFrame([("t1", None), ("t2", "m2"), ("t3", "m4"), ("x", "m9")], "thread_id string, parent_message_id string")
    rows = [("m1", "t1", "user", "a", 1), ("m2", "t1", "assistant", "b", 2), ("m3", "t1", "user", "late", 3), ("m4", "t2", "user", "c", 4), ("m5", "t3", "user", "d", 5), ("m9", "x", "user", "loop", 1)]
    messages = spark.createDataFrame([(*r[:4], stamp(r[4])) for r in rows], "message_id string, thread_id string, role string, content string, created_at timestamp_ntz")
    branch = context.active_branch(threads, messages, 3)
    got = {r.leaf_id: [m.content for m in r.branch] for r in context.branch_messages(branch, messages).collect()}
    assert got["t3"] == ["a", "b", "c", "d"] and got["t1"] == ["a", "b", "late"] and got["x"] == ["loop"] * 3
    s = context.Settings(digest_older_message_characters=100, digest_latest_message_characters=200)
    df = spark.createDataFrame([(1, 2, [("user", "y" * 150), ("assistant", "z" * 250)])], "k int, message_count int, m array<struct<role:string,content:string>>")
    made = df.select("k", "message_count", context.digest(F.col("m"), s).alias("content"))
    assert made.first().content == "1. user: " + "y" * 100 + "\n2. assistant: " + "z" * 200
    for count, version in ((2, 4), (3, 5)):
        stored = spark.createDataFrame([(1, 4, count, "old")], "k int, version int, message_count int, content string")
        assert context.digest_version(made, stored, "k").first().version == version


def test_cache_jobs_images_and_replay(spark):
    wanted = spark.createDataFrame([("a", "brief"), ("a", "study"), ("b", "brief"), ("b", "brief")], "version_id string, tier string")
    cached = spark.createDataFrame([("a", "brief")], "version_id string, tier string")
    jobs = spark.createDataFrame([(1, "a", "study", "running"), (2, "b", "brief", "failed"), (3, "c", "brief", "running"), (4, "d", "brief", "running")], "job_id long, version_id string, tier string, status string")
    assert [tuple(r) for r in context.jobs_to_queue(wanted, cached, jobs, ["version_id", "tier"]).collect()] == [("b", "brief")]
    results = spark.createDataFrame([(1, "notes", "h1"), (3, "brief", "old"), (4, "x" * 50, "h4")], "job_id long, content string, text_hash string")
    texts = spark.createDataFrame([("a", "h1"), ("c", "new"), ("d", "h4")], "version_id string, text_hash string")
    done = {r.job_id: (r.status, r.content) for r in context.finish_jobs(jobs, results, texts, {"brief": 5, "study": 5}).collect()}
    assert done == {1: ("completed", "notes"), 2: ("failed", None), 3: ("cancelled", None), 4: ("failed", None)}
    png = bytearray(b"\x89PNG\r\n\x1a\n0")
    df = spark.createDataFrame([(png, "text", None), (bytearray(b"GIF"), "image", "asset:x"), (None, "svg", "<svg>"), (None, "text", None)], "u binary, t string, v string")
    assert [r[0] for r in df.select(context.run_image(F.col("u"), F.col("t"), F.col("v"))).collect()] == ["upload", "asset", "svg", None]
    fresh, old = context.replay(spark.createDataFrame([("r1",), ("r2",), ("r2",)], "request_id string"), spark.createDataFrame([("r1", 7)], "request_id string, run int"))
    assert [r.request_id for r in fresh.collect()] == ["r2"] and old.first().run == 7


def test_templates(spark):
    table = templates.catalogue(spark)
    assert table.count() == 30 and templates.validate(table.withColumnRenamed("default_template", "template")).where("valid").count() == 30
    df = spark.createDataFrame([("{{action}}", "b}")], "v string, w string")
    assert df.select(templates.render("x {{ v }}-{{w}}{{gone}} y", {"v": F.col("v"), "w": F.col("w")})).first()[0] == "x {{action}}-b} y"
    saved = spark.createDataFrame([("scope.thread", "{{action}}!"), ("request.define", "Please do this with the selection: define.")], "key string, template string")
    old = spark.createDataFrame([("request.define", "own"), ("request.tldr", "kept")], "key string, template string")
    assert {r.key: r.template for r in templates.save(old, saved, table).collect()} == {"scope.thread": "{{action}}!", "request.tldr": "kept"}


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controll", "control"), ("rate", "rate"), ("sky", "sky")])
def test_porter(word, want):
    assert search.stem(word) == want


def test_search_grammar(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma", "t"), (2, "beta alpha", "delta"), (3, "gamma delta epsilon alpha", "")], "i int, body string, title string")
    lines = df.select("i", search.token_line(F.col("body")).alias("body"), search.token_line(F.col("title")).alias("title"))
    cases = {"alpha beta": [1, 2], '"alpha beta"': [1], "gam*": [1, 3], "alpha NOT beta": [3], "epsilon OR t": [1, 3], "title : delta": [2], "NEAR(gamma alpha, 1)": [1], "NEAR(gamma alpha, 2)": [1, 3], "(beta OR delta) AND gamma": [1, 3], '"alpha be"*': [1]}
    for query, want in cases.items():
        hit = search.matches({c: F.col(c) for c in ("body", "title")}, search.parse(query))
        assert [r.i for r in lines.where(hit).orderBy("i").collect()] == want, query
    for bad in ("", "  ", '"open', "a AND", "(a", "NOT"):
        with pytest.raises(search.ParseError):
            search.parse(bad)


def test_edits(spark):
    assert edits.changed_range("one two three", "one 2 three") == (4, 7, "2")
    text = spark.createDataFrame([(1, "a", "hello world"), (1, "b", "stay"), (1, "c", "bad")], "document_id long, block_id string, text string")
    fields = "seq long, type string, block_id string, text string, start_offset long, end_offset long, style string, enabled boolean, folded boolean, label string, number string, caption string, width double"
    op = lambda seq, kind, block, **kw: (1, seq, kind, block, *(kw.get(k) for k in ("text", "start_offset", "end_offset", "style", "enabled", "folded", "label", "number", "caption", "width")))
    ops = [op(1, "format", "a", start_offset=6, end_offset=11, style="bold", enabled=True), op(2, "replace_text", "a", text="hello wide world"), op(3, "resize", "a", width=640.0), op(4, "fold", "a", folded=True), op(5, "caption", "a", label="Fig", number="2", caption="x"), op(6, "resize", "c", width=640.5), op(7, "fold", "zz", folded=True)]
    got = {r.block_id: r for r in edits.apply_operations(text, spark.createDataFrame(ops, "document_id long, " + fields)).collect()}
    assert got["a"].html == "hello <strong>wide world</strong>"  # new text takes the style before it
    assert (got["a"].text, got["a"].width, got["a"].folded, got["a"].caption) == ("hello wide world", 640, True, "Fig 2: x")
    assert got["b"].text == "stay" and got["c"].error and got["zz"].error == "unknown block"
    revisions = spark.createDataFrame([(1, 1, "r1")], "document_id long, revision long, content string")
    after, bad = edits.save(revisions, spark.createDataFrame([(1, 1, "r2"), (1, 0, "stale")], "document_id long, base_revision long, content string"))
    assert after.count() == 2 and bad.first().content == "stale"
    originals, wanted = spark.createDataFrame([(1, "r0")], "document_id long, content string"), spark.createDataFrame([(1, 0)], "document_id long, target long")
    assert edits.restore(after, originals, wanted).orderBy(F.col("revision").desc()).first().content == "r0"


def test_artifacts_and_exports(spark):
    df = spark.createDataFrame([("```json\n{\"a\":1}\n```",), ("no",)], "t string")
    assert [r[0] for r in df.select(artifacts.valid_json(F.col("t"))).collect()] == [True, False]
    good = '{"title":"t","layout":"flow","nodes":[{"id":"a"},{"id":"b"}],"edges":[{"from":"a","to":"b"}]}'
    df = spark.createDataFrame([(good,), (good.replace("flow", "star"),), (good.replace('"id":"a"', '"id":"a b"'),), ("junk",)], "t string")
    assert [bool(r[0]) for r in df.select(artifacts.diagram_problems(F.col("t"))).collect()] == [False, True, True, True]
    recap = '{"title":"t","sections":[' + ",".join('{"heading":"h"}' for _ in range(7)) + "]}"
    assert spark.createDataFrame([(recap,)], "t string").select(artifacts.recap_problems(F.col("t"))).first()[0] == ["sections"]
    notes = spark.createDataFrame([(1, 0, "q", ""), (1, 5, "r", "note")], "d int, at int, quote string, note string")
    assert exports.notebook(notes, "d", "at", "quote", "note").first().markdown == f"> q [^1]\n\n> r [^2]\n\n[^1]: {exports.DEFAULT_NOTE}\n[^2]: note"
    sizes = spark.createDataFrame([("x" * n,) for n in (5, 400, 401, 1200, 1201)], "n string")
    assert [r[0] for r in sizes.select(exports.placement(F.col("n"))).collect()] == ["inline", "inline", "footnote", "footnote", "appendix"]
    names = exports.unique_names(spark.createDataFrame([(1, "A"), (2, "a")], "id int, title string"), "id", "title").orderBy("id").collect()
    assert [r.filename for r in names] == ["A.html", "a-2.html"]


def test_cancelled_jobs(spark):
    jobs = spark.createDataFrame([(1, "queued", None), (2, "completed", None)], "id int, status string, error string")
    assert [tuple(r) for r in store.cancel_jobs(jobs, "why").orderBy("id").collect()] == [(1, "cancelled", "why"), (2, "completed", None)]


def test_event_folds(spark):
    stamp = dt.datetime(2024, 1, 1)
    rows = [("r", 2, "text_delta", "b"), ("r", 1, "text_delta", "a"), ("r", 3, "tool_call", None), ("r", 4, "tool_call", None), ("r", 5, "completed", None)]
    full = [(*r, None, 0, "f" if r[1] == 3 else None, {3: "{", 4: "}"}.get(r[1]), 7 if r[1] == 5 else None, 8 if r[1] == 5 else None, "stop" if r[1] == 5 else None, stamp) for r in rows]
    df = spark.createDataFrame(full, ev.EVENT)
    row = ev.fold(df).first()
    assert (row.answer, tuple(row.usage), row.finish_reason, row.n_events) == ("ab", (7, 8), "stop", 5)
    assert tuple(ev.tool_calls(df).first())[1:] == (0, "f", "{}")


def test_whole_texts_are_escaped(spark, tmp_path):
    import hashlib
    from html import escape

    from studylake import plans

    text = 'a & b < "c" > d; ' * 500
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.html_length, r.html_hash) for r in plans.QUERIES["html_escape_whole"](spark, str(tmp_path)).collect()}
    want = escape(text + '<a href="x">&')
    assert got == {1: (len(want), hashlib.sha256(want.encode()).hexdigest()), 2: (None, None)}


def test_assets_of_whole_pages_are_embedded(spark, tmp_path):
    from studylake import plans

    html = "<p>" + "long " * 2000 + '<a href="x">end</a>'
    spark.createDataFrame([(7, html)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in plans.QUERIES["asset_inline_whole"](spark, str(tmp_path)).collect()]
    assert got == [(7, html.replace("href=", "data:text/plain;base64,cDc=="))]


def test_whole_texts_are_cleaned_for_filenames(spark, tmp_path):
    from studylake import plans

    text = 'a\x01b <c>:"d" / e\\f|?*\n g  ' * 100
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in plans.QUERIES["filename_clean_whole"](spark, str(tmp_path)).collect()]
    assert got == [(1, " ".join("a b cd ef g" for _ in range(100)))]


def test_rows_are_numbered_across_ranges(spark):
    from studylake.operators import relational

    df = spark.createDataFrame([("a" if i % 10 else "b", i) for i in range(500)], "k string, i long").repartition(7)
    got = relational.numbered(df, "k", "i", "n").collect()
    for k in "ab":
        rows = sorted((r.i, r.n) for r in got if r.k == k)
        assert [n for _, n in rows] == list(range(1, len(rows) + 1))
    assert relational.numbered(df.limit(0), "k", "i", "n").count() == 0


def test_quotes_meet_blocks_by_their_words(spark):
    quotes = [(1, "quick brown fox jumps"), (2, "ick brown fo"), (3, "fox"), (4, "ck bro"), (5, "absent words stand here now"), (6, "“é” — ünder dem Tor, dem"), (7, "")]
    texts = ["The quick brown fox jumps over.", "A quick brown, fox", "ein “é” — ünder dem Tor, dem alten", "fox fox"]
    text = spark.createDataFrame([(7, i, t, 0) for i, t in enumerate(texts)], "d long, ordinal long, text string, start long")
    anchor = spark.createDataFrame([(i, q, "", "", 0) for i, q in quotes], "anchor_id long, exact string, prefix string, suffix string, anchor_start long")
    got = {r.anchor_id: (r.ordinal, r.start_offset) for r in anchors.exact_matches(anchor, text, [], ["d"]).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert all(texts[n].startswith(dict(quotes)[i], at) for i, (n, at) in got.items())
    assert anchors.exact_matches(anchor.limit(0), text, [], ["d"]).count() == 0


def test_positions_of_many_elements(spark):
    from studylake.functions import arrays

    df = spark.range(1).select(F.sequence(F.lit(1).cast("long"), F.lit(1000).cast("long")).alias("n"))
    assert list(df.select(arrays.starts("n")).first()[0]) == [i * (i + 1) // 2 for i in range(1000)]
    assert spark.range(1).select(arrays.starts(F.array().cast("array<bigint>"))).first()[0] == []


def test_branches_of_many_threads(spark):
    n = 4000
    threads = spark.range(n).select(F.col("id").alias("thread_id"), F.when(F.col("id") % 40 > 0, F.col("id") - 1).alias("parent_message_id"))
    messages = spark.range(n).select(F.col("id").alias("message_id"), F.col("id").alias("thread_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")
    try:
        assert context.active_branch(threads, messages, 32).count() == sum(min(i % 40 + 1, 32) for i in range(n))
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_media_is_refused_after_other_edits(spark):
    fields = "document_id long, block_id string, block_type string, text string, visual string"
    original = spark.createDataFrame([(d, b, k, "old", v) for d in (1, 2, 3) for b, k, v in (("t", "text", None), ("i", "image", "asset:a"))], fields)
    edited = spark.createDataFrame([(1, "t", "text", "new", None), (2, "t", "text", "new", None), (3, "t", "text", "new", None), (3, "i", "image", "", "asset:a")], fields)
    history = spark.createDataFrame([(1, "replace_text"), (2, "resize"), (3, "format")], "document_id long, type string")
    got = sorted((r.document_id, r.block_id, r.text, r.repaired) for r in edits.repair_media(original, edited, history).collect())
    assert got == [(1, "i", "old", True), (1, "t", "new", True), (2, "t", "new", False), (3, "i", "", False), (3, "t", "new", False)]


def test_settings_as_a_table(spark):
    from dataclasses import asdict

    rows = [context.Settings(), context.Settings(quick_context_max_tokens=100, study_context_percent=10), context.Settings(thread_ancestor_limit=0)]
    df = spark.createDataFrame([tuple(asdict(s).values()) for s in rows], ", ".join(f"{k} int" for k in asdict(rows[0])))
    assert [sorted(r[0]) for r in df.select(context.settings_problems()).collect()] == [sorted(s.problems()) for s in rows]
