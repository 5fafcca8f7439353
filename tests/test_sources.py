import base64
import io
import json
import zipfile

from pyspark.sql import functions as F

from studylake.functions import text as tx
from studylake.sources import assets, html, sse

PNG = base64.b64encode(b"\x89PNG\r\n\x1a\n" + b"0" * 10).decode()


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_paths(spark):
    cases = {"../x.css?v=1": "a/x.css", "../../../up.png": None, "https://h/x": None, "javascript:x": None, "/x": None, "": None, "./c//d#e": "a/b/c/d", "i\\e.gif": "a/b/i/e.gif", "../..": ""}
    assert [assets.normal_path("a/b", v) for v in cases] == list(cases.values())
    assert column(spark, list(cases), lambda v: assets.normal_path_column(F.lit("a/b"), v)) == list(cases.values())


def test_embedded_images_and_videos(spark):
    assert assets.safe_data_uri(f"data:image/png;base64,{PNG}") == f"data:image/png;base64,{PNG}"
    assert assets.safe_data_uri(f"data:image/gif;base64,{PNG}") is None
    assert assets.safe_data_uri("data:image/svg+xml;base64,PHN2Zz4=") is None
    cases = {
        "https://www.youtube.com/embed/abc_def-1?rel=0&start=5&bad=1": "https://www.youtube-nocookie.com/embed/abc_def-1?start=5&rel=0",
        "https://youtube-nocookie.com/embed/abcdef": "https://www.youtube-nocookie.com/embed/abcdef",
        "http://www.youtube.com/embed/abcdef": None, "https://vimeo.com/embed/abcdef": None, "https://www.youtube.com/watch": None, "not a url": None,
    }
    assert [assets.embed_url(v) for v in cases] == list(cases.values())
    assert column(spark, list(cases), assets.embed_url_column) == list(cases.values())


def test_page_is_sanitised_and_cut(spark):
    page = (
        '<html><head><title> A  title </title><style>@import "x"; p{background:url(http://x/y)}</style><script>evil("</p>")</script></head>'
        '<body onload="x()"><h1>One</h1><p onclick=1>a <b>bold<p>two &amp; three<ul><li>x<li>y</ul>'
        f'<figure><img src="data:image/png;base64,{PNG}" alt="pic"><figcaption>cap</figcaption></figure><img src="../up.png" alt=""><p></p>'
        '<iframe src="https://evil/embed/abcdef"></iframe><blockquote><p>in</p> quote</blockquote><form>gone</form></body></html>'
    )
    clean, title, blocks = html.cut(page, "dir/page.html")
    assert title == "A title"
    assert [(t, k, x) for t, k, x, *_ in blocks] == [
        ("h1", "text", "One"), ("p", "text", "a bold"), ("p", "text", "two & three"), ("li", "text", "x"), ("li", "text", "y"),
        ("figure", "diagram", "cap"), ("img", "image", "pic"), ("img", "image", ""), ("p", "text", ""), ("blockquote", "text", "in quote"),
    ]
    assert blocks[6][3].startswith("data:image/png") and blocks[7][3] == "asset:up.png"
    for bad in ("script", "onclick", "onload", "evil", "gone", "@import", "http://x"):
        assert bad not in clean
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>a</p><p>a</p>"), (4, '<p data-block-id="block-x">a</p>')], "page_id long, html string")
    assert html.page_blocks(df, "page_id", "html", keep_ids=True).where("page_id = 4").first().block_id == "block-x"
    rows = html.page_blocks(df, "page_id", "html").where("page_id = 3").orderBy("ordinal").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 1), (3, 4)] and rows[0].block_id != rows[1].block_id


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def test_archives(spark):
    files = {
        "good": archive(index_dot_html="<p>", css__a_dot_css="a{}"), "up": archive(**{"..__x_dot_html": "x"}), "bomb": archive(x_dot_html="a" * 2_000_000),
        "odd": archive(x_dot_exe="x"), "two": archive(b_dot_html="b", a_dot_html="a"), "none": b"no",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    rows = assets.read_archives(df).collect()
    reasons = {r.path: r.reject_reason for r in rows if r.reject_reason}
    assert reasons == {"up": "unsafe path", "bomb": "compression ratio", "odd": "extension", "none": "not an archive"}
    assert all(r.content is None for r in rows if r.reject_reason) and bytes(next(r for r in rows if r.entry == "index.html").content) == b"<p>"
    entries = assets.read_archives(df)
    chosen = spark.createDataFrame([("two", "a.html"), ("good", "x.html")], "path string, entry string")
    plain = {r.path: (r.entry, r.error) for r in assets.choose_entry(entries).collect()}
    named = {r.path: (r.entry, r.error) for r in assets.choose_entry(entries, chosen).collect()}
    assert plain["good"] == ("index.html", None) and plain["two"] == (None, None) and plain["bomb"] == (None, "no page")
    assert named["two"] == ("a.html", None) and named["good"] == (None, "no such entry")


def test_event_streams(spark):
    typed = 'event: x\ndata: {"type":"response.output_text.delta","delta":"Hi"}\n\ndata: {"type":"response.completed","response":{"usage":{"input_tokens":3,"output_tokens":2}}}\n\ndata: {"ta'
    chat = 'data: {"choices":[{"delta":{"content":"a"}}]}\r\n\r\ndata: {"choices":[{"delta":{"tool_calls":[{"function":{"name":"f","arguments":"{"}}]}}]}\r\n\r\ndata: [DONE]\r\n\r\n'
    chunks = [("t", i, "responses", typed[a : a + 20]) for i, a in enumerate(range(0, len(typed), 20))] + [("c", 0, "chat", chat)]
    got = sse.events(spark.createDataFrame(chunks, "run_id string, seq long, protocol string, body string")).orderBy("run_id", "seq").collect()
    assert [(r.run_id, r.type, r.delta, r.tool_name, r.finish_reason) for r in got] == [
        ("c", "text_delta", "a", None, None), ("c", "tool_call", None, "f", None), ("c", "completed", None, None, "stop"),
        ("t", "text_delta", "Hi", None, None), ("t", "completed", None, None, "completed"),
    ]
    assert (got[-1].input_tokens, got[-1].output_tokens) == (3, 2)
    assert column(spark, [typed], sse.tail) == ['data: {"ta']
    models = json.dumps({"data": [{"id": "m", "context_length": 9}, {"id": "n", "name": "N"}]})
    assert [tuple(m) for m in column(spark, [models], sse.catalogue)[0]] == [("m", "m", 9), ("n", "N", 0)]


def test_text_functions(spark):
    assert column(spark, ["a 　b\n\tc ", "", "﻿x"], tx.collapse) == ["a b c", "", "x"]
    assert column(spark, ["a😀b"], tx.code_units) == [4]
    assert column(spark, ["ÉA"], tx.lower_ascii) == ["Éa"]
    assert column(spark, ['a/b: c?', "  ..", "ﬁ\x01x.", "y" * 130], lambda v: tx.file_stem(v)) == ["ab c", "Untitled", "fi x", "y" * 120]
    assert column(spark, ["same", "a b c", "", "x y"], lambda v: tx.similarity(v, F.lit("same"))) == [1.0, 0.0, 0.0, 0.0]
    assert column(spark, ["A b, b", "c"], lambda v: tx.similarity(v, F.lit("a B x"))) == [2 / 3, 0.0]


def test_styles_are_scanned():
    seen = lambda v: f"asset:{v}" if v and not v.startswith("http") else None
    assert assets.safe_css('@IMPORT url("a;b.css"); p{background:URL( "x.png" )}', seen) == ' p{background:url("asset:x.png")}'
    assert assets.safe_css("a{b:url('y)z.png');c:url(http://h)}", seen) == 'a{b:url("asset:y)z.png");c:url("")}'
    assert assets.safe_css("i{width:expression (1)} @import x", seen) == "i{width:} "
