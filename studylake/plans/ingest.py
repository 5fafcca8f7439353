"""Ingestion queries over raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import assets, html, sse
from .registry import query, read


@query()
def page_blocks(spark, sf_dir):
    """HTM-1, HTM-2, HTM-3: blocks of raw pages."""
    return html.page_blocks(read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_sanitize(spark, sf_dir):
    """HTM-1, HTM-5, HTM-7: clean HTML and titles."""
    parsed = html.parse_pages(read(spark, sf_dir, "pages"), "page_id", "html", "url")
    return parsed.select("page_id", "title", F.length("html").alias("html_chars"), F.sha2("html", 256).alias("html_hash"), F.size("blocks").alias("n_blocks"))


@query("""WITH t AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages)
SELECT page_id, CASE WHEN title <> '' THEN title WHEN regexp_extract(url, '([^/]+)$', 1) <> '' THEN regexp_extract(url, '([^/]+)$', 1) ELSE 'Untitled' END AS title FROM t""")
def title_fallback(spark, sf_dir):
    """HTM-5 as expressions, for pages whose title holds no entities."""
    from ..functions import text as tx

    title = tx.collapse(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return read(spark, sf_dir, "pages").select("page_id", tx.or_else(title, F.regexp_extract("url", "([^/]+)$", 1), F.lit("Untitled")).alias("title"))


@query("""WITH v AS (SELECT page_id, 'a/b' AS base, CASE page_id % 6 WHEN 0 THEN '../x.css?v=1' WHEN 1 THEN '../../../up.png' WHEN 2 THEN url WHEN 3 THEN './c//d.js#top' WHEN 4 THEN '/root.css' ELSE 'img\\e.gif' END AS value FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a/x.css' WHEN 3 THEN 'a/b/c/d.js' WHEN 5 THEN 'a/b/img/e.gif' END AS path FROM v""")
def path_normalize(spark, sf_dir):
    """HTM-6."""
    k = F.col("page_id") % 6
    value = F.when(k == 0, "../x.css?v=1").when(k == 1, "../../../up.png").when(k == 2, F.col("url")).when(k == 3, "./c//d.js#top").when(k == 4, "/root.css").otherwise("img\\e.gif")
    return read(spark, sf_dir, "pages").select("page_id", assets.normal_path_column(F.lit("a/b"), value).alias("path"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.youtube-nocookie.com/embed/video' || page_id || '?start=5&rel=0' END AS embed FROM pages""")
def video_url(spark, sf_dir):
    """HTM-8, TXT-9 (address parts and parameters): known hosts keep known parameters, in their order; others and plain pages give none."""
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    value = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/embed/video"), n, F.lit("?rel=0&x=1&start=5"))).when(k == 1, F.concat(F.lit("https://example.org/embed/video"), n)).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", assets.embed_url_column(value).alias("embed"))


@query("""SELECT page_id, ['png', 'jpg', 'gif', 'css', 'woff2'][page_id % 5 + 1] AS extension, page_id % 2 = 0 OR page_id % 5 = 3 AS valid FROM pages""")
def media_magic(spark, sf_dir):
    """SRC-6, SRC-7: right magic bytes for even pages; any text without NUL is a stylesheet."""
    names = F.array(*map(F.lit, ("png", "jpg", "gif", "css", "woff2")))
    heads = F.array(*(F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "61", "774F463200")))
    at = (F.col("page_id") % 5 + 1).cast("int")
    content = F.when(F.col("page_id") % 2 == 0, F.element_at(heads, at)).otherwise(F.encode(F.lit("plain"), "UTF-8"))
    extension = F.element_at(names, at)
    return read(spark, sf_dir, "pages").select("page_id", extension.alias("extension"), assets.valid_asset(extension, content).alias("valid"))


@query("""SELECT conv_id AS run_id, 'text_delta' AS type, string_agg(text, '' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id""")
def sse_parse(spark, sf_dir):
    """SRC-10, AGG-15: turns as chunks of a typed event stream, cut in the middle of frames."""
    frame = F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("response.output_text.delta").alias("type"), F.col("text").alias("delta"))), F.lit("\n\n"))
    framed = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), "turn", frame.alias("f"))
    half = F.floor(F.length("f") / 2).cast("int")
    pieces = F.array(F.struct((F.col("turn") * 2).alias("seq"), F.substr(F.col("f"), F.lit(1), half).alias("body")), F.struct((F.col("turn") * 2 + 1).alias("seq"), F.substr(F.col("f"), half + 1).alias("body")))
    chunks = framed.select("run_id", F.lit("responses").alias("protocol"), F.explode(pieces).alias("c")).select("run_id", "c.seq", "protocol", "c.body")
    found = sse.events(chunks)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return found.groupBy("run_id", "type").agg(F.array_join(F.transform(ordered, lambda d: d["delta"]), "").alias("answer"))
