"""Queries of archives, artifacts, indexes, settings and exports."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import artifacts, context, exports, search, store
from ..sources import assets, html, imports, sse
from ..streaming import events as ev
from .registry import query, read


def _column(page, pairs, rest=None):
    """A value by the page's number modulo the count of ``pairs``."""
    out = F.lit(rest)
    for i, value in enumerate(pairs):
        out = F.when(page % len(pairs) == i, value).otherwise(out)
    return out


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'html' WHEN 2 THEN 'zip' END AS kind FROM pages""")
def import_kind(spark, sf_dir):
    """SRC-3: what can be imported, by name, first bytes and size."""
    k = F.col("page_id")
    name = _column(k, ["a.html", "B.HTM", "c.zip", "d.zip", "e.txt"])
    content = _column(k, [F.encode("html", "UTF-8"), F.encode("html", "UTF-8"), F.unhex(F.lit("504B0304")), F.unhex(F.lit("0000")), F.encode("html", "UTF-8")])
    return read(spark, sf_dir, "pages").select("page_id", assets.import_kind(name, content).alias("kind"))


def _archives(spark, sf_dir):
    """An archive for each page: alone, with a second page, with a style, with an unsafe path, with a foreign file, or broken."""

    def pack(frames):
        for frame in frames:
            made = []
            for n, page in zip(frame["page_id"], frame["html"]):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("index.html", page or "")
                    extra = {1: "b/other.htm", 2: "style.css", 3: "../up.html", 4: "run.exe"}.get(n % 6)
                    if extra:
                        z.writestr(extra, "x")
                made.append(b"broken" if n % 6 == 5 else out.getvalue())
            yield pd.DataFrame({"path": frame["page_id"].astype(str), "content": made})

    return read(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(pack, "path string, content binary")


@query("""WITH p AS (SELECT page_id, html, page_id % 6 AS k FROM pages), e AS (
SELECT page_id, 'index.html' AS entry, k, CASE k WHEN 3 THEN 'unsafe path' WHEN 4 THEN 'extension' END AS reason, octet_length(encode(html)) AS size FROM p WHERE k <> 5
UNION ALL SELECT page_id, ['', 'b/other.htm', 'style.css', '../up.html', 'run.exe'][k + 1], k, CASE k WHEN 3 THEN 'unsafe path' WHEN 4 THEN 'extension' END, 1 FROM p WHERE k BETWEEN 1 AND 4
UNION ALL SELECT page_id, NULL, k, 'not an archive', NULL FROM p WHERE k = 5)
SELECT CAST(page_id AS VARCHAR) AS path, entry, reason AS reject_reason, CASE WHEN reason IS NULL THEN size END AS content_bytes FROM e""")
def zip_entries(spark, sf_dir):
    """SRC-4: entries of archives; one unsafe entry rejects its archive."""
    return assets.read_archives(_archives(spark, sf_dir)).select("path", "entry", "reject_reason", F.octet_length("content").cast("long").alias("content_bytes"))


@query("""SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 6 IN (0, 2) AND page_id % 5 <> 0 THEN 'index.html' WHEN page_id % 6 = 1 AND page_id % 5 = 0 THEN 'b/other.htm' END AS entry,
CASE page_id % 6 WHEN 0 THEN 'index.html' WHEN 1 THEN 'b/other.htm,index.html' WHEN 2 THEN 'index.html' ELSE '' END AS choices,
CASE WHEN page_id % 6 > 2 THEN 'no page' WHEN page_id % 5 = 0 AND page_id % 6 <> 1 THEN 'no such entry' END AS error FROM pages""")
def zip_choice(spark, sf_dir):
    """SRC-5: the only page of an archive, the one that was named, or the sorted choices; each fifth names one."""
    chosen = read(spark, sf_dir, "pages").where("page_id % 5 = 0").select(F.col("page_id").cast("string").alias("path"), F.lit("b/other.htm").alias("entry"))
    found = assets.choose_entry(assets.read_archives(_archives(spark, sf_dir)), chosen)
    return found.select("path", "entry", F.array_join("choices", ",").alias("choices"), "error")


@query("""WITH p AS (SELECT page_id, html, page_id % 6 AS k, CASE WHEN page_id % 10 = 0 THEN 'old-' || page_id ELSE 'doc-' || substr(sha256(html), 1, 20) END AS document_id FROM pages)
SELECT 'h' || page_id AS path, 'html' AS kind, NULL AS entry, '' AS choices, NULL AS error, document_id, page_id % 10 = 0 AS duplicate FROM p
UNION ALL SELECT 'z' || page_id, CASE WHEN k < 5 THEN 'zip' END, CASE WHEN k IN (0, 2) THEN 'index.html' END, CASE k WHEN 0 THEN 'index.html' WHEN 1 THEN 'b/other.htm,index.html' WHEN 2 THEN 'index.html' ELSE '' END,
  CASE k WHEN 3 THEN 'unsafe path' WHEN 4 THEN 'extension' WHEN 5 THEN 'no page or archive, or too large' END, CASE WHEN k IN (0, 2) THEN document_id END, k IN (0, 2) FROM p""")
def import_sources(spark, sf_dir):
    """SRC-3, SRC-5, HTM-9: every page as it is and in an archive; each tenth page is stored already."""
    pages = read(spark, sf_dir, "pages")
    n, body = F.col("page_id").cast("string"), F.encode("html", "UTF-8")
    alone = pages.select(F.concat(F.lit("h"), n).alias("path"), F.concat(n, F.lit(".html")).alias("name"), body.alias("content"))
    packed = _archives(spark, sf_dir).select(F.concat(F.lit("z"), "path").alias("path"), F.concat("path", F.lit(".zip")).alias("name"), "content")
    stored = pages.where("page_id % 10 = 0").select(F.sha2(body, 256).alias("content_hash"), F.concat(F.lit("old-"), n).alias("document_id"))
    return imports.import_sources(alone.unionByName(packed), stored).withColumn("choices", F.array_join("choices", ","))


@query("""WITH v AS (SELECT page_id, replace(base64(unhex('89504E470D0A1A0A') || encode('' || page_id)), chr(10), '') AS b FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'data:image/png;base64,' || b WHEN 4 THEN 'data:image/png;base64,' || b END AS uri FROM v""")
def data_uri_check(spark, sf_dir):
    """SRC-8, ENC: embedded images in canonical form; wrong types, other media and broken base64 give none."""
    k = F.col("page_id")
    payload = F.regexp_replace(F.base64(F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode(k.cast("string"), "UTF-8"))), r"\s", "")
    put = lambda head, body: F.concat(F.lit(f"{head},"), body)
    png = "data:image/png;base64"
    value = _column(k, [put(png, payload), put("data:image/gif;base64", payload), put("data:image/svg+xml;base64", payload), put(png, F.lit("a")), put("DATA:image/PNG;base64", F.concat(F.lit(" "), payload, F.lit("\n")))])
    return read(spark, sf_dir, "pages").select("page_id", assets.safe_data_uri_column(value).alias("uri"))


@query("""SELECT p_brand AS provider, 'm' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'm' || p_partkey END AS label, CASE p_partkey % 3 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 10 ELSE 0 END AS context_window FROM part""")
def model_catalogue(spark, sf_dir):
    """SRC-11: providers' lists of models, with names and windows filled in."""
    k = F.col("p_partkey")
    model = F.struct(
        F.concat(F.lit("m"), k.cast("string")).alias("id"), F.when(k % 2 == 0, F.col("p_name")).when(k % 4 == 1, "").alias("name"),
        F.when(k % 3 == 0, F.col("p_size") * 1000).alias("context_window"), F.when(k % 3 == 1, F.col("p_size") * 10).alias("context_length"),
    )
    raw = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(model).alias("data"))).alias("raw"))
    return raw.select(F.col("p_brand").alias("provider"), F.explode(sse.catalogue(F.col("raw"))).alias("m")).select("provider", "m.id", "m.label", "m.context_window")


@query("""SELECT o_custkey AS document_id, count(*) + 1 AS exports, 'markdown' AS newest FROM orders GROUP BY 1""")
def export_history(spark, sf_dir):
    """SNK-11: orders as the history of exports, and a new export of every document."""
    orders = read(spark, sf_dir, "orders")
    history = orders.select(F.col("o_custkey").alias("document_id"), F.lit("html").alias("format"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    after = exports.log_exports(history, history.select("document_id").distinct(), "markdown", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    return after.groupBy("document_id").agg(F.count("*").alias("exports"), F.max_by("format", "created_at").alias("newest"))


def _library(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.format_string("Page %d", F.col("page_id") % 50).alias("title"), "html")
    return exports.library(pages, "page_id", "title")


@query("""WITH p AS (SELECT page_id, page_id % 50 AS t, min(page_id) OVER (PARTITION BY page_id % 50) AS first, html FROM pages)
SELECT page_id, 'Page ' || t || CASE WHEN page_id <> first THEN '-' || page_id ELSE '' END || '.html' AS filename, sha256(html) AS html_hash FROM p""")
def library_pages(spark, sf_dir):
    """SNK-12: a page for each document, under a name of its own."""
    return _library(spark, sf_dir).select("page_id", "filename", F.sha2("html", 256).alias("html_hash"))


@query("""WITH p AS (SELECT page_id, page_id % 50 AS t, min(page_id) OVER (PARTITION BY page_id % 50) AS first FROM pages)
SELECT '{"page_id":' || page_id || ',"filename":"Page ' || t || CASE WHEN page_id <> first THEN '-' || page_id ELSE '' END || '.html"}' AS line FROM p
UNION ALL SELECT '{"documents_count":' || count(*) || '}' FROM p""")
def library_manifest(spark, sf_dir):
    """SNK-12, JSON: a line for each document, and one with their count."""
    return exports.manifest(_library(spark, sf_dir), ["page_id", "filename"])


@query("""SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status, CASE WHEN o_orderstatus <> 'F' THEN 'settings changed' END AS error FROM orders""")
def cache_invalidate(spark, sf_dir):
    """SNK-13: jobs that wait or run are cancelled with a reason."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    jobs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.lit(None).cast("string").alias("error"))
    return store.cancel_jobs(jobs, "settings changed")


@query("""SELECT p_partkey, p_partkey % 4 <> 3 AS valid, CASE WHEN p_partkey % 4 <> 3 THEN p_name END AS title, CASE WHEN p_partkey % 4 <> 3 THEN p_size % 8 END AS sections,
CASE WHEN p_partkey % 4 = 3 THEN 'title,sections' WHEN p_size % 8 BETWEEN 1 AND 6 THEN '' ELSE 'sections' END AS problems FROM part""")
def recap_contract(spark, sf_dir):
    """ART-5, ART-7, PRJ-3: fenced, plain and broken answers; what is JSON is decoded and held against the recap's contract."""
    k = F.col("p_partkey") % 4
    sections = F.when(F.col("p_size") % 8 > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("p_size") % 8, F.lit(1))), lambda i: F.struct(F.concat(F.lit("h"), i.cast("string")).alias("heading")))).otherwise(F.array().cast("array<struct<heading:string>>"))
    body = F.to_json(F.struct(F.col("p_name").alias("title"), sections.alias("sections")))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(k == 2, body).otherwise(F.substr(body, F.lit(1), F.lit(5)))
    json = artifacts.unfence(raw)
    decoded = F.from_json(json, artifacts.RECAP)
    valid = artifacts.valid_json(raw)
    return read(spark, sf_dir, "part").select(
        "p_partkey", valid.alias("valid"), F.when(valid, decoded["title"]).alias("title"), F.when(valid, F.size(decoded["sections"])).alias("sections"), F.array_join(artifacts.recap_problems(json), ",").alias("problems")
    )


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 7 = 0 THEN 'title' END, CASE WHEN p_partkey % 6 = 0 THEN 'layout' END, CASE WHEN p_size > 24 THEN 'nodes' END, CASE WHEN p_size > 40 THEN 'edges' END, CASE WHEN p_partkey % 5 = 0 THEN 'node id' END) AS problems FROM part""")
def diagram_contract(spark, sf_dir):
    """ART-6: titles, layouts, numbers of nodes and edges, and ids."""
    k = F.col("p_partkey")
    upto = F.sequence(F.lit(1), F.col("p_size"))
    nodes = F.transform(upto, lambda i: F.struct(F.concat(F.when(k % 5 == 0, "a b").otherwise("n"), i.cast("string")).alias("id")))
    edges = F.transform(upto, lambda i: F.struct(F.lit("n1").alias("from"), F.concat(F.lit("n"), i.cast("string")).alias("to")))
    layout = F.when(k % 6 == 0, "star").otherwise(F.element_at(F.array(*map(F.lit, artifacts.LAYOUTS)), (k % 5 + 1).cast("int")))
    json = F.to_json(F.struct(F.when(k % 7 == 0, "").otherwise(F.col("p_name")).alias("title"), layout.alias("layout"), nodes.alias("nodes"), edges.alias("edges")))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(artifacts.diagram_problems(json), ",").alias("problems"))


@query("""SELECT DISTINCT 'img_' || p_partkey % 20 AS image_id FROM part""")
def image_references(spark, sf_dir):
    """AGG-18: different images that artifacts refer to."""
    content = F.format_string('{"imageId": "img_%d", "again": {"imageId":"img_%d"}}', F.col("p_partkey") % 20, F.col("p_partkey") % 20)
    return read(spark, sf_dir, "part").select(F.explode(artifacts.image_ids(content)).alias("image_id")).distinct()


@query("""SELECT conv_id AS run_id, turn % 2 AS tool_index, 'tool' || turn % 2 AS tool_name, string_agg(text, '' ORDER BY turn) AS arguments FROM conversations GROUP BY conv_id, turn % 2""")
def tool_calls(spark, sf_dir):
    """AGG-16: turns as chunks of two tools' arguments."""
    turns = read(spark, sf_dir, "conversations")
    chunks = turns.select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.lit("tool_call").alias("type"), (F.col("turn") % 2).alias("tool_index"),
        F.when(F.col("turn") < 2, F.concat(F.lit("tool"), (F.col("turn") % 2).cast("string"))).alias("tool_name"), F.col("text").alias("tool_input"),
    )
    return ev.tool_calls(chunks)


def _index(spark, sf_dir):
    docs, turns, orders = read(spark, sf_dir, "documents", "conversations", "orders")
    none, at = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at")
    name = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    articles = docs.select(name("d", F.col("doc_id")).alias("entity_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("lang").alias("tags"), none.alias("model_id"), at)
    turn_id = F.concat_ws("-", "conv_id", "turn")
    answers = turns.select(turn_id.alias("entity_id"), F.col("conv_id").alias("document_id"), F.col("text").alias("body"), none.alias("tags"), F.lit("m").alias("model_id"), at, "role")
    made = orders.select(name("o", F.col("o_orderkey")).alias("entity_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"), none.alias("tags"), none.alias("model_id"), at)
    return search.index_rows(articles, answers, made)


_INDEX = """i AS (SELECT 'article' AS kind, 'd' || doc_id AS entity_id, doc_id AS document_id, source AS title, text AS body FROM documents
UNION ALL SELECT 'answer', conv_id || '-' || turn, conv_id, '', text FROM conversations WHERE role = 'assistant'
UNION ALL SELECT 'artifact', 'o' || o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders)"""


@query(f"WITH {_INDEX} SELECT kind, entity_id, document_id, title, sha256(body) AS body_hash FROM i")
def index_rows(spark, sf_dir):
    """FTS-2, FTS-3, FTS-4: articles, answers of the assistant without a title, and artifacts under their kind."""
    return _index(spark, sf_dir).select("kind", "entity_id", "document_id", "title", F.sha2("body", 256).alias("body_hash"))


@query(f"""WITH {_INDEX} SELECT kind, CASE WHEN kind = 'artifact' AND document_id % 4 = 0 THEN 'new' ELSE title END AS title, count(*) AS n FROM i GROUP BY 1, 2""")
def index_refresh(spark, sf_dir):
    """FTS-4, FTS-5: artifacts of each fourth customer are written anew; their rows give way to the new ones."""
    index = _index(spark, sf_dir)
    changed = index.where("kind = 'artifact' and document_id % 4 = 0").withColumn("title", F.lit("new"))
    return search.refresh(index, changed).groupBy("kind", "title").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN p_size < 20 THEN 'quick_context_percent must be from 5 to 100' END, CASE WHEN p_partkey % 3 = 0 THEN 'thread_ancestor_limit must be from 1 to 128' END,
CASE WHEN p_size * 2 < 60 AND p_size >= 20 OR p_size < 20 THEN NULL ELSE 'study_context_percent must be at least quick_context_percent' END) AS problems FROM
(SELECT p_partkey, CASE WHEN p_size < 20 THEN 1 ELSE p_size END AS p_size FROM part)""")
def settings_check(spark, sf_dir):
    """CTX-8: settings with their defaults but for three, checked by range and against each other."""
    k, n = F.col("p_partkey"), F.col("p_size")
    own = {"quick_context_percent": F.when(n < 20, 1).otherwise(n * 2), "study_context_percent": F.lit(58), "thread_ancestor_limit": F.when(k % 3 == 0, 0).otherwise(32)}
    values = {f: own.get(f, F.lit(v)) for f, v in context.asdict(context.Settings()).items()}
    rows = read(spark, sf_dir, "part").select("p_partkey", *(v.alias(f) for f, v in values.items()))
    return rows.select("p_partkey", F.array_join(context.settings_problems(), "; ").alias("problems"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'upload' WHEN 1 THEN 'asset' WHEN 2 THEN 'svg' END AS origin FROM pages""")
def run_image(spark, sf_dir):
    """CTX-10: an uploaded picture, the block's own, or none."""
    k = F.col("page_id")
    upload = _column(k, [F.unhex(F.lit("89504E470D0A1A0A00")), F.unhex(F.lit("474946")), F.lit(None).cast("binary"), F.lit(None).cast("binary")])
    visual = _column(k, [F.lit(None).cast("string"), F.lit("asset:a"), F.lit("<svg></svg>"), F.lit("")])
    kind = _column(k, ["text", "image", "svg", "image"])
    return read(spark, sf_dir, "pages").select("page_id", context.run_image(upload, kind, visual).alias("origin"))


@query("""WITH v AS (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY 1), h AS (SELECT l.doc_id, count(*) AS n FROM labels l WHERE quality = 1 GROUP BY 1),
m AS (SELECT conv_id % 7 AS s, string_agg(role || ':' || conv_id || ':' || turn, ',' ORDER BY conv_id, turn) AS said, count(*) AS n FROM conversations GROUP BY 1)
SELECT v.source AS document_id, v.doc_id AS version, sha256('<p>' || v.doc_id || '</p><img src="data:text/plain;base64,' || base64(encode('v' || v.doc_id)) || '">') AS html_hash, coalesce(h.n, 0) AS highlights,
  1 AS artifacts, coalesce(sha256(m.said), '') AS said FROM v LEFT JOIN h ON h.doc_id = v.doc_id LEFT JOIN m ON 'src' || m.s = v.source""")
def export_document(spark, sf_dir):
    """EX-1: newest version without scripts, assets embedded, checked highlights, promoted artifacts, and the transcript."""
    docs, labels, turns = read(spark, sf_dir, "documents", "labels", "conversations")
    n = F.col("doc_id").cast("string")
    page = F.concat(F.lit("<p>"), n, F.lit("</p><SCRIPT type=x>evil('<p>')</script ><img src=\"asset:pic\">"))
    versions = docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("version"), F.col("doc_id").alias("version_id"), F.col("text").alias("canonical_text"), page.alias("html"))
    pictures = docs.select(F.col("doc_id").alias("version_id"), F.lit("pic").alias("asset_id"), F.lit("text/plain").alias("mime"), F.encode(F.concat(F.lit("v"), n), "UTF-8").alias("content"))
    marks = labels.select(F.col("doc_id").alias("version_id"), (F.col("quality") == 1).alias("checked"), F.lit(0).alias("start_offset"), F.lit("q").alias("exact_quote"), F.lit("").alias("note"))
    documents = docs.select(F.col("source").alias("document_id")).distinct()
    kept = documents.select("document_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("promoted"), F.lit(1).alias("created_at"), F.lit("tldr").alias("kind"), F.lit("c").alias("content"))
    said = turns.select(F.concat(F.lit("src"), (F.col("conv_id") % 7).cast("string")).alias("document_id"), F.struct("conv_id", "turn").alias("created_at"), "role", F.concat_ws(":", "conv_id", "turn").alias("content"))
    out = exports.export_data(documents, versions, marks, kept, pictures, said)
    script = F.array_join(F.transform("transcript", lambda t: F.concat_ws(":", t["role"], t["content"])), ",")
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(c)
    return out.select("document_id", "version", F.sha2("html", 256).alias("html_hash"), count("highlights"), count("artifacts"), F.coalesce(F.sha2(script, 256), F.lit("")).alias("said"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace('![pic](x.png) <b>bold</b> 1 < 2 ' || text, '!\\[([^\\]]*)\\]\\([^)]*\\)', '[image: \\1]', 'g'), '</?[A-Za-z][^>]*>', '', 'g')) AS shown FROM documents""")
def markdown_plain(spark, sf_dir):
    """EX-8: Markdown for display, without raw HTML, pictures as their text."""
    text = F.concat(F.lit("![pic](x.png) <b>bold</b> 1 < 2 "), "text")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(exports.plain_markdown(text), 256).alias("shown"))


@query("""WITH b AS (SELECT page_id, unnest(range(0, 6)) AS i FROM pages), t AS (SELECT page_id, i, CASE i WHEN 0 THEN 'Head ' || page_id WHEN 1 THEN 'one two' WHEN 2 THEN 'item' WHEN 3 THEN 'pic' WHEN 4 THEN 'in quote' ELSE '' END AS text FROM b)
SELECT page_id, i AS ordinal, ['h1', 'p', 'li', 'img', 'blockquote', 'p'][i + 1] AS tag, CASE i WHEN 3 THEN 'image' ELSE 'text' END AS block_type, text, CASE i WHEN 3 THEN 'asset:a/p' || page_id || '.png' END AS visual,
  CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM t""")
def page_cut(spark, sf_dir):
    """HTM-1, HTM-2: a page made from each page's number, cut into blocks; scripts go, nested blocks are their parents'."""
    return html.page_blocks(_made_pages(spark, sf_dir), "page_id", "html", "path").select("page_id", "ordinal", "tag", "block_type", "text", "visual", "start")


def _made_pages(spark, sf_dir):
    n = F.col("page_id").cast("string")
    page = F.concat(
        F.lit("<head><title> T "), n, F.lit(" </title><style>@import 'x.css'; b{background:URL('p.png')} i{width:expression(alert(1))}</style></head><body onload='x()'><script>p('<p>')</script><h1>Head "), n,
        F.lit("</h1><p onclick='y'>one <b>two</b><ul><li>item</ul><img alt='pic' src='p"), n, F.lit(".png'><blockquote><p>in</p> quote</blockquote><p></p></body>"),
    )
    return read(spark, sf_dir, "pages").select("page_id", page.alias("html"), F.lit("a/index.html").alias("path"))


@query("""SELECT page_id, 'T ' || page_id AS title, '<style> b{background:url("asset:a/p.png")} i{width:)}</style><head></head><body><h1>Head ' || page_id || '</h1><p>one <b>two</b></p><ul><li>item</li></ul><img alt="pic" src="asset:a/p' || page_id ||
  '.png" srcset=""><blockquote><p>in</p> quote</blockquote><p></p></body>' AS html FROM pages""")
def page_clean(spark, sf_dir):
    """HTM-1, HTM-5, HTM-7: the same pages cleaned: no scripts, handlers, imports or expressions; addresses of assets."""
    return html.parse_pages(_made_pages(spark, sf_dir), "page_id", "html", "path").select("page_id", "title", "html")
