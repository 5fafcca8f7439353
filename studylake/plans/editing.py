"""Queries of edits: operations, revisions, conflicts, restoring, migrated annotations, media repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import anchors, edits
from ..operators import relational as rel
from ..sources import html
from .registry import query, read

_FIELDS = {"text": "string", "start_offset": "bigint", "end_offset": "bigint", "style": "string", "enabled": "boolean", "folded": "boolean", "label": "string", "number": "string", "caption": "string", "width": "double"}


def _op(rows, seq, kind, **values):
    """Operations of one kind on the blocks of ``rows``."""
    fields = [F.lit(values[f]).cast(t).alias(f) if f in values and not isinstance(values[f], F.Column) else values.get(f, F.lit(None)).cast(t).alias(f) for f, t in _FIELDS.items()]
    return rows.select("document_id", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("type"), "block_id", *fields)


def _edited(spark, sf_dir):
    """Parts as blocks of documents, with an operation or two on most, by their number."""
    part = read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("document_id"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("block_id"), F.col("p_name").alias("text"), "p_partkey", "p_brand", "p_size")
    k = lambda n: part.where(F.col("p_partkey") % 7 == n)
    first = F.length(F.split("text", " ")[0])
    bold = dict(start_offset=F.lit(0), end_offset=first, style="bold", enabled=True)
    ops = [
        _op(k(0), 1, "format", **bold), _op(k(0), 2, "replace_text", text=F.concat(F.lit("7 "), "text")),
        _op(k(1), 1, "format", **bold), _op(k(1), 2, "format", start_offset=F.lit(0), end_offset=first, style="bold", enabled=False), _op(k(1), 3, "format", start_offset=F.lit(0), end_offset=F.length("text"), style="italic", enabled=True),
        _op(k(2), 1, "fold", folded=True), _op(k(2), 2, "caption", label="Fig", number=F.col("p_size").cast("string"), caption=F.col("p_brand")),
        _op(k(3), 1, "resize", width=(F.col("p_size") + 48).cast("double")), _op(k(3), 2, "caption", label=" ", number="", caption=""),
        _op(k(4), 1, "replace_text", text="lost"), _op(k(4), 2, "resize", width=10.0),
        _op(k(5).withColumn("block_id", F.concat(F.lit("gone"), F.col("p_partkey").cast("string"))), 1, "fold", folded=True),
    ]
    return part, reduce(lambda a, b: a.unionByName(b), ops)


@query("""WITH p AS (SELECT *, p_partkey % 7 AS k, p_partkey % 50 AS document_id, split_part(p_name, ' ', 1) AS w FROM part)
SELECT document_id, 'b' || p_partkey AS block_id, CASE WHEN k = 0 THEN '7 ' || p_name ELSE p_name END AS text,
  CASE k WHEN 0 THEN '<strong>7 ' || w || '</strong>' || substr(p_name, length(w) + 1) WHEN 1 THEN '<em>' || p_name || '</em>' ELSE p_name END AS html,
  k = 2 AS folded, CASE WHEN k = 2 THEN 'Fig ' || p_size || ': ' || p_brand END AS caption, CASE WHEN k = 3 THEN p_size + 48 END AS width, k = 4 AS wrong FROM p
UNION ALL SELECT document_id, 'gone' || p_partkey, NULL, NULL, false, NULL, NULL, true FROM p WHERE k = 5""")
def edit_apply(spark, sf_dir):
    """ED-1, ED-2, ED-3, ED-5, ED-6: formats, text that takes the style before it, folds, captions, widths; wrong operations
    and unknown blocks are told and change nothing."""
    part, ops = _edited(spark, sf_dir)
    done = edits.apply_operations(part.select("document_id", "block_id", "text"), ops)
    return done.select("document_id", "block_id", "text", "html", "folded", "caption", "width", F.col("error").isNotNull().alias("wrong"))


def _revisions(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", F.col("o_orderstatus").alias("content"))
    w = rel.Window.partitionBy("document_id").orderBy("o_orderkey")
    return orders.select("document_id", F.row_number().over(w).cast("long").alias("revision"), "content")


@query("""WITH n AS (SELECT c_custkey, count(o_orderkey) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey AS document_id, top + CASE WHEN c_custkey % 3 = 0 AND top > 0 THEN 0 ELSE 1 END AS revisions,
  CASE WHEN c_custkey % 3 = 0 AND top > 0 THEN 2 ELSE 1 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS conflicts, CASE WHEN c_custkey % 3 = 0 AND top > 0 THEN 0 ELSE 1 END AS nulls FROM n""")
def edit_save(spark, sf_dir):
    """ED-7: every customer saves twice the same without content on the newest revision, each third on an old one; each second
    saves once more from nowhere."""
    revisions, customer = _revisions(spark, sf_dir), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    top = customer.join(revisions.groupBy("document_id").agg(F.max("revision").alias("top")), "document_id", "left").withColumn("top", F.coalesce("top", F.lit(0)))
    stale = (F.col("document_id") % 3 == 0) & (F.col("top") > 0)
    saves = top.select("document_id", F.when(stale, F.col("top") - 1).otherwise(F.col("top")).alias("base_revision"), F.lit(None).cast("string").alias("content"))
    far = top.where("document_id % 2 = 0").select("document_id", (F.col("top") + 9).alias("base_revision"), F.lit("far").alias("content"))
    after, bad = edits.save(revisions, saves.unionByName(saves).unionByName(far))
    counts = after.groupBy("document_id").agg(F.max("revision").alias("revisions"), F.count_if(F.col("content").isNull()).alias("nulls"))
    conflicts = bad.groupBy("document_id").agg(F.count("*").alias("conflicts"))
    out = customer.join(counts, "document_id", "left").join(conflicts, "document_id", "left")
    return out.select("document_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("revisions", "conflicts", "nulls")))


@query("""WITH n AS (SELECT o_custkey, count(*) AS top, arg_min(o_orderstatus, o_orderkey) AS first FROM orders GROUP BY 1)
SELECT o_custkey AS document_id, top + 1 AS revision, CASE WHEN o_custkey % 2 = 0 THEN 'original' ELSE first END AS content FROM n""")
def edit_restore(spark, sf_dir):
    """ED-9: the original is restored for even documents, the first revision for odd ones; each is a new revision."""
    revisions = _revisions(spark, sf_dir)
    documents = revisions.select("document_id").distinct()
    wanted = documents.select("document_id", (F.col("document_id") % 2).alias("target"))
    after = edits.restore(revisions, documents.withColumn("content", F.lit("original")), wanted)
    return after.groupBy("document_id").agg(F.max("revision").alias("revision"), F.max_by("content", "revision").alias("content"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS revision, sha256(CASE WHEN page_id % 3 = 0 THEN '<p>' || page_id || '</p>' ELSE html END) AS html_hash FROM pages""")
def effective_html(spark, sf_dir):
    """SRC-9, AGG-6, ED-10: the newest revision's HTML, or the page as it came."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("original"))
    edited = pages.where("page_id % 3 = 0").select("page_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("r"))
    edited = edited.withColumn("html", F.when(F.col("r") == 2, F.format_string("<p>%d</p>", "page_id")).otherwise("old"))
    found = rel.newest_or_default(pages, edited, "page_id", "r", {"html": F.col("original")})
    return found.select("page_id", "revision", F.sha2("html", 256).alias("html_hash"))


def _versions(spark, sf_dir):
    """Each part's name as a quote in an old version, and the blocks of a new one; each third has lost the quote."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    quote = part.select(
        F.col("p_partkey").alias("anchor_id"), F.col("p_partkey").alias("v"), F.col("p_name").alias("exact"), F.lit("seen in ").alias("prefix"), F.lit(" as sold").alias("suffix"), F.lit(30).cast("long").alias("anchor_start")
    )
    lost = F.col("p_partkey") % 3 == 0
    text = F.when(lost, F.lit("0 1 2 3 4 5 6 7 8 9")).otherwise(F.concat(F.lit("It is seen in "), "p_name", F.lit(" as sold before, and then "), "p_name", F.lit(" once more.")))
    head = part.select(F.col("p_partkey").alias("v"), F.lit(0).cast("long").alias("ordinal"), F.lit("Kept for later").alias("text"), F.lit(0).cast("long").alias("start"))
    body = part.select(F.col("p_partkey").alias("v"), F.lit(1).cast("long").alias("ordinal"), text.alias("text"), F.lit(16).cast("long").alias("start"))
    return quote, head.unionByName(body)


@query("""SELECT p_partkey AS anchor_id, CASE WHEN p_partkey % 3 = 0 THEN 'unmatched' ELSE 'attached' END AS status, CASE WHEN p_partkey % 3 <> 0 THEN 30 END AS start_offset,
CASE WHEN p_partkey % 3 <> 0 THEN 30 + length(p_name) END AS end_offset, CASE WHEN p_partkey % 3 <> 0 THEN 'It is seen in ' END AS prefix,
CASE WHEN p_partkey % 3 <> 0 THEN substr(' as sold before, and then ' || p_name || ' once more.', 1, 32) END AS suffix, CASE WHEN p_partkey % 3 <> 0 THEN CAST(1.01 AS DOUBLE) END AS score FROM part""")
def anchor_refresh(spark, sf_dir):
    """ANC-1 (context and place), ANC-4: the occurrence with the old context, and 32 characters of new context on each side."""
    quotes, text = _versions(spark, sf_dir)
    placed = anchors.reattach(quotes, text, ["v"]).join(quotes.select("anchor_id", "v"), "anchor_id")
    fresh = anchors.refresh_context(placed, text, ["v"])
    found = F.col("status") == "attached"
    value = lambda c: F.when(found, F.col(c)).alias(c)
    return fresh.select("anchor_id", "status", value("start_offset"), value("end_offset"), value("prefix"), value("suffix"), F.when(found, F.round("score", 6)).alias("score"))


@query("""SELECT 'thread' AS kind, p_partkey AS id, substr(sha256(p_partkey || chr(0) || 2), 1, 20) AS anchor_id, CAST(NULL AS BIGINT) AS came_from FROM part
UNION ALL SELECT 'anchor', p_partkey, substr(sha256(p_partkey || chr(0) || 2), 1, 20), p_partkey FROM part
UNION ALL SELECT 'highlight', p_partkey, substr(sha256(p_partkey || chr(0) || 2), 1, 20), NULL FROM part WHERE p_partkey % 2 = 0""")
def anchor_threads(spark, sf_dir):
    """ANC-3: anchors of a version move to the next, naming where they come from; threads are repointed, highlights copied."""
    quotes, text = _versions(spark, sf_dir)
    key = F.col("anchor_id")
    marks = quotes.where(key % 2 == 0).select(key.alias("highlight_id"), "anchor_id", key.alias("of"))
    moved, copies, threads = anchors.migrate(quotes, marks, anchors.reattach(quotes, text, ["v"]), F.lit(2), quotes.select(key.alias("thread_id"), "anchor_id"))
    none = F.lit(None).cast("long")
    out = threads.select(F.lit("thread").alias("kind"), F.col("thread_id").alias("id"), "anchor_id", none.alias("came_from"))
    out = out.unionByName(moved.select(F.lit("anchor").alias("kind"), F.col("migrated_from_id").alias("id"), "anchor_id", F.col("migrated_from_id").alias("came_from")))
    return out.unionByName(copies.select(F.lit("highlight").alias("kind"), F.col("of").alias("id"), "anchor_id", none.alias("came_from")))


@query("""SELECT p_partkey AS anchor_id, 'attached' AS status, CASE WHEN p_partkey % 3 = 0 THEN 18 ELSE 30 END AS start_offset, CASE WHEN p_partkey % 3 = 0 THEN 21 ELSE 30 + length(p_name) END AS end_offset FROM part""")
def anchor_repair(spark, sf_dir):
    """ANC-7: anchors that were lost are put by hand, at places counted within the block."""
    quotes, text = _versions(spark, sf_dir)
    placed = anchors.reattach(quotes, text, ["v"])
    one = lambda n: F.lit(n).cast("long")
    by_hand = placed.where("status = 'unmatched'").select("anchor_id", F.col("anchor_id").alias("v"), one(1).alias("ordinal"), one(2).alias("local_start"), one(5).alias("local_end"))
    return anchors.repair(placed, by_hand, text, "v").select("anchor_id", "status", "start_offset", "end_offset")


@query("""SELECT page_id, ordinal, block_id, text FROM (SELECT page_id, unnest([0, 1, 2]) AS ordinal, unnest(['kept-' || page_id, 'block-' || substr(sha256('p' || chr(0) || 'new' || chr(0) || '0'), 1, 20), 'cap-' || page_id]) AS block_id,
  unnest(['old ' || page_id, 'new', 'A caption']) AS text FROM pages)""")
def page_reindex(spark, sf_dir):
    """HTM-11: an edited page's blocks keep the ids that it names; a new one gets its own."""
    n = F.col("page_id").cast("string")
    page = F.concat(F.lit('<p data-block-id="kept-'), n, F.lit('">old '), n, F.lit('</p><p>new</p><figcaption data-block-id="cap-'), n, F.lit('">A caption</figcaption>'))
    found = html.page_blocks(read(spark, sf_dir, "pages").select("page_id", page.alias("html")), "page_id", "html", keep_ids=True)
    return found.select("page_id", "ordinal", "block_id", "text")


@query("""SELECT page_id AS document_id, b AS block_id, CASE WHEN b = 'text' THEN 'edited ' || page_id ELSE '' END AS text, CASE WHEN b = 'img' AND page_id % 4 < 2 THEN 'asset:a' END AS visual, page_id % 4 < 2 AS repaired
FROM (SELECT page_id, unnest(['text', 'img']) AS b FROM pages) WHERE NOT (b = 'img' AND page_id % 4 >= 2)""")
def media_repair(spark, sf_dir):
    """HTM-12: pictures that an edit lost come back with the edited text; a document that lost none, or whose history holds more
    than text edits, stays as edited."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"))
    n, kind = F.col("document_id"), F.col("block_type")
    both = pages.select("document_id", F.explode(F.array(F.lit("text"), F.lit("img"))).alias("block_id")).withColumn("block_type", F.when(F.col("block_id") == "img", "image").otherwise("text"))
    original = both.where(~((kind == "image") & (n % 4 == 2))).withColumn("text", F.when(kind == "text", "first").otherwise("")).withColumn("visual", F.when(kind == "image", "asset:a"))
    edited = both.where(kind == "text").withColumn("text", F.format_string("edited %d", n)).withColumn("visual", F.lit(None).cast("string"))
    history = pages.select("document_id", F.when(n % 4 == 3, "resize").otherwise("replace_text").alias("type"))
    return edits.repair_media(original, edited, history).select("document_id", "block_id", "text", "visual", "repaired")
