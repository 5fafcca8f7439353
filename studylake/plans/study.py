"""Search, artifact, export, edit and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import artifacts, exports, search
from ..streaming import events as ev
from .registry import query, read

#: Constant queries: terms that all must occur.
QUERIES = {"q1": ["the", "of", "and"], "q2": ["les", "de"], "q3": ["die", "und", "der"]}
_TERMS = ", ".join(f"('{q}', '{t}', {len(ts)})" for q, ts in QUERIES.items() for t in ts)
_BM25 = f"""t AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
l AS (SELECT doc_id, source, len(w) AS n FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
q(query, term, k) AS (VALUES {_TERMS}),
h AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
p AS (SELECT query, h.doc_id, source, k, ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS part
  FROM h JOIN d USING (term) JOIN q USING (term) JOIN l USING (doc_id), s),
c AS (SELECT query, doc_id, source, round(sum(part), 6) AS score FROM p GROUP BY query, doc_id, source, k HAVING count(*) = k)"""


def _scored(spark, sf_dir, limit):
    queries = spark.createDataFrame(list(QUERIES.items()), "query string, terms array<string>")
    return search.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", queries, limit)


@query(f"WITH {_BM25} SELECT query, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS r FROM c) WHERE r <= 100")
def search_bm25(spark, sf_dir):
    """FTS-1, FTS-6, FTS-7, SRT-6: a top-100 report for each query."""
    return _scored(spark, sf_dir, 100)


@query(f"WITH {_BM25} SELECT query, source, count(*) AS hits, max(score) AS best FROM c WHERE source <> 'src0' GROUP BY query, source")
def search_filters(spark, sf_dir):
    """FTS-9, FLT-9: facets over all hits."""
    docs = read(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id", "source")
    return _scored(spark, sf_dir, None).join(docs, "doc_id").groupBy("query", "source").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


@query("""WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS w FROM documents)
SELECT doc_id FROM t WHERE (contains(w, ' of the ') OR regexp_matches(w, ' theth[a-z0-9]* ')) AND contains(w, ' and ') AND NOT contains(w, ' les ')""")
def search_boolean(spark, sf_dir):
    """FTS-6, FLT-11: phrase, prefix, OR, AND and NOT."""
    tree = search.parse('("of the" OR theth*) and NOT les')
    docs = read(spark, sf_dir, "documents").select("doc_id", search.token_line(F.col("text")).alias("body"))
    return docs.where(search.matches({"body": F.col("body")}, tree)).select("doc_id")


@query()
def search_stemmed(spark, sf_dir):
    """FTS-1: BM25 over Porter stems, in a vectorised UDF."""
    queries = spark.createDataFrame([("q1", [search.stem(w) for w in ("the", "ands")])], "query string, terms array<string>")
    return search.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", queries, 100, stems=True)


@query()
def search_snippet(spark, sf_dir):
    """FTS-8: snippets of the best hundred hits of a query; the UDF sees those alone."""
    best = _scored(spark, sf_dir, 100).where("query = 'q1'")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(best.select("doc_id")), "doc_id")
    return docs.select("doc_id", search.snippet(F.col("text"), F.array(*map(F.lit, QUERIES["q1"]))).alias("snippet"))


@query("""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS word_count, CAST(least(len(w), 150) AS BIGINT) AS out_words, sha256(CASE WHEN len(w) > 150 THEN array_to_string(w[1:150], ' ') || '…' ELSE text END) AS out_hash FROM w""")
def tldr_truncate(spark, sf_dir):
    """ART-4."""
    n = artifacts.word_count(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("word_count"), F.least(n, F.lit(150)).cast("long").alias("out_words"), F.sha2(artifacts.truncate(F.col("text")), 256).alias("out_hash"))


_SPACE = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(f"""WITH w AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'tldr' ELSE 'half-page' END AS kind, len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '')) AS n,
  len(regexp_extract_all(text, '(?:^|[\\n\\r\\x{{2028}}\\x{{2029}}]){_SPACE}*[-*]')) AS bullets FROM documents)
SELECT doc_id, kind, concat_ws(', ', CASE WHEN coalesce(trim(text), '') = '' THEN 'text is required' END, CASE WHEN kind = 'tldr' AND n > 150 THEN 'more than 150 words' END,
  CASE WHEN kind = 'tldr' AND bullets > 5 THEN 'more than 5 bullets' END, CASE WHEN kind = 'half-page' AND n NOT BETWEEN 300 AND 450 THEN 'not 300 to 450 words' END) AS problems FROM w""")
def artifact_validate(spark, sf_dir):
    """ART-3."""
    kind = F.when(F.col("doc_id") % 2 == 0, "tldr").otherwise("half-page")
    docs = read(spark, sf_dir, "documents").withColumn("kind", kind)
    return docs.select("doc_id", "kind", F.array_join(artifacts.problems(F.col("kind"), F.col("text")), ", ").alias("problems"))


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
a AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)
SELECT coalesce(s.o_custkey, a.o_custkey) AS scope_id, CASE coalesce(s.o_orderpriority, a.o_orderpriority) WHEN '1-URGENT' THEN 'tldr' ELSE 'note' END AS kind,
  coalesce(s.o_orderpriority, a.o_orderpriority) AS scope_type,
  CASE WHEN coalesce(s.o_orderpriority, a.o_orderpriority) = '1-URGENT' THEN greatest(coalesce(s.n, 0), 1) ELSE coalesce(s.n, 0) + coalesce(a.n, 0) END AS n_versions
FROM s FULL JOIN a ON a.o_custkey = s.o_custkey AND a.o_orderpriority = s.o_orderpriority""")
def artifact_save(spark, sf_dir):
    """ART-1, SNK-3, AGG-5: finished orders are stored artifacts, open ones arrive; urgent ones are of a singleton kind."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "tldr").otherwise("note")
    rows = read(spark, sf_dir, "orders").select(kind.alias("kind"), F.col("o_orderpriority").alias("scope_type"), F.col("o_custkey").alias("scope_id"), "o_orderstatus", F.col("o_orderkey").alias("content"))
    w = artifacts.Window.partitionBy("kind", "scope_type", "scope_id").orderBy("content")
    stored = rows.where("o_orderstatus = 'F'").drop("o_orderstatus").withColumn("version", F.row_number().over(w).cast("long"))
    new = rows.where("o_orderstatus = 'O'").drop("o_orderstatus").withColumn("version", F.lit(None).cast("long"))
    return artifacts.save(stored, new, "content").groupBy("scope_id", "kind", "scope_type").agg(F.count("*").alias("n_versions"))


@query("""SELECT conv_id, role || turn AS id, 80 + 170 * (i % 2) AS x, 45 + 85 * (i // 2) AS y FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)""")
def diagram_layout(spark, sf_dir):
    """ART-8: turns as a diagram's nodes."""
    turns = read(spark, sf_dir, "conversations")
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: F.struct(F.concat(t["role"], t["turn"].cast("string")).alias("id")))
    return artifacts.layout_nodes(turns.groupBy("conv_id").agg(nodes.alias("nodes")), "conv_id")


@query("""SELECT a.conv_id, a.role || a.turn AS source, b.role || b.turn AS target FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE b.role = 'assistant'""")
def diagram_edges(spark, sf_dir):
    """ART-8: an edge from each turn to an assistant's next; those without both ends go."""
    turns = read(spark, sf_dir, "conversations")
    name = lambda role, turn: F.concat(role, turn.cast("string"))
    nodes = F.transform(F.collect_list(F.struct("turn", "role")), lambda t: F.struct(name(t["role"], t["turn"]).alias("id")))
    edges = F.transform(F.collect_list(F.struct("turn", "role")), lambda t: F.struct(name(t["role"], t["turn"]).alias("from"), name(F.lit("assistant"), t["turn"] + 1).alias("to")))
    made = artifacts.layout_edges(turns.groupBy("conv_id").agg(nodes.alias("nodes"), edges.alias("edges")), "conv_id")
    return made.select("conv_id", F.col("from").alias("source"), F.col("to").alias("target"))


@query("""SELECT CASE WHEN length(text) <= 400 THEN 'inline' WHEN length(text) <= 1200 THEN 'footnote' ELSE 'appendix' END AS bucket, count(*) AS n FROM documents GROUP BY 1""")
def note_placement(spark, sf_dir):
    """EX-3."""
    return read(spark, sf_dir, "documents").groupBy(exports.placement(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal,
'[^' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || ']: ' || CASE WHEN doc_id % 3 = 0 OR text = '' THEN 'Highlighted without a note.' ELSE text END AS line FROM documents""")
def markdown_footnotes(spark, sf_dir):
    """EX-4."""
    note = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.split("text", "\n")[0].alias("quote"), note.alias("note"))
    return exports.footnotes(docs, "source", "doc_id", "quote", "note").select("source", "ordinal", "line")


@query("""WITH u AS (SELECT page_id, html, 'data:text/plain;base64,' || base64(encode('p' || page_id)) AS a1, 'data:text/plain;base64,' || base64(encode('q' || page_id)) AS a10 FROM pages),
s AS (SELECT *, 'data:text/css;base64,' || base64(encode('i{' || a1 || '}')) AS c0 FROM u), t AS (SELECT *, 'data:text/css;base64,' || base64(encode('b{url(' || a10 || ')} ' || c0)) AS c1 FROM s)
SELECT page_id, replace(html, 'href=', a10 || '=') || '<link ' || c1 || '> ' || a1 || ' asset:a' AS html FROM t""")
def asset_inline(spark, sf_dir):
    """EX-2, ENC: whole pages with two assets, one's id a prefix of the other's, and two style sheets, one in the other."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.replace("html", F.lit("href="), F.lit("asset:a10=")), F.lit("<link asset:c1> asset:a1 asset:a")).alias("html"))
    own = lambda head: F.concat(F.lit(head), F.col("page_id").cast("string"))
    made = {"a1": ("text/plain", own("p")), "a10": ("text/plain", own("q")), "c0": ("text/css", F.lit("i{asset:a1}")), "c1": ("text/css", F.lit("b{url(asset:a10)} asset:c0"))}
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("asset_id"), F.lit(m).alias("mime"), F.encode(c, "UTF-8").alias("content")) for i, (m, c) in made.items())))
    return exports.embed_assets(pages, pages.select("page_id", each.alias("a")).select("page_id", "a.*"), "page_id", "html")


@query("""SELECT page_id, replace(html, 'href=', 'data:text/plain;base64,' || base64(encode('p' || page_id)) || '=') AS html FROM pages""")
def asset_inline_whole(spark, sf_dir):
    """EX-2 over whole pages, as ``asset_inline``."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("href="), F.lit("asset:a1=")).alias("html"))
    content = F.encode(F.concat(F.lit("p"), F.col("page_id").cast("string")), "UTF-8")
    assets = pages.select("page_id", F.lit("a1").alias("asset_id"), F.lit("text/plain").alias("mime"), content.alias("content"))
    return exports.embed_assets(pages, assets, "page_id", "html")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '[<>:"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def filename_clean(spark, sf_dir):
    """HTM-14 but for its compatibility forms, length and dots."""
    clean = F.regexp_replace("text", r"[\x00-\x1F\x7F]", " ")
    return read(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.regexp_replace(clean, tx.RESERVED, "")).alias("cleaned"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '[<>:"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM documents""")
def filename_clean_whole(spark, sf_dir):
    """``filename_clean`` again, under the name that it had for whole texts."""
    clean = F.regexp_replace("text", r"[\x00-\x1F\x7F]", " ")
    return read(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.regexp_replace(clean, tx.RESERVED, "")).alias("cleaned"))


@query()
def filename_safe(spark, sf_dir):
    """HTM-14: compatibility forms need Python."""
    return exports.unique_names(read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("title")), "doc_id", "title").select("doc_id", "filename")


@query("""SELECT user_id, string_agg(n || ' ' || event_type, ', ' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def edit_summary(spark, sf_dir):
    """AGG-9, AGG-17, EX-7: operation counts of each user."""
    counted = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).select("user_id", exports.edit_label(F.col("m")).alias("summary"))


@query("""SELECT o_custkey AS document_id, o_orderkey AS revision FROM orders UNION ALL SELECT c_custkey, 0 FROM customer""")
def edit_history(spark, sf_dir):
    """ED-8: revisions and the synthetic revision 0."""
    from ..operators import edits

    customer, orders = read(spark, sf_dir, "customer", "orders")
    revisions = orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("revision"))
    return edits.history(revisions, customer.select(F.col("c_custkey").alias("document_id"))).select("document_id", "revision")


_RUN = """e AS (SELECT *, CASE event_type WHEN 'view' THEN 'text_delta' WHEN 'click' THEN 'citation' WHEN 'purchase' THEN 'usage' ELSE 'completed' END AS type FROM events)"""


@query(f"""WITH {_RUN}, c AS (SELECT user_id, 'u' || event_id % 5 AS url, min(event_id) AS o FROM e WHERE type = 'citation' GROUP BY 1, 2),
l AS (SELECT user_id, string_agg(url, ',' ORDER BY o) AS citations FROM c GROUP BY 1)
SELECT e.user_id, count(*) AS n_events, coalesce(string_agg('d' || event_id, '' ORDER BY event_id) FILTER (WHERE type = 'text_delta'), '') AS answer, min(ts) FILTER (WHERE type = 'text_delta') AS first_text_at,
  arg_max(event_id % 100, event_id) FILTER (WHERE type = 'usage') AS input_tokens, arg_max(event_id % 10, event_id) FILTER (WHERE type = 'usage') AS output_tokens,
  arg_max('end' || event_id % 3, event_id) FILTER (WHERE type = 'completed') AS finish_reason, coalesce(max(citations), '') AS citations
FROM e LEFT JOIN l ON l.user_id = e.user_id GROUP BY e.user_id""")
def event_fold(spark, sf_dir):
    """AGG-15, CTX-11: a user's events as a run's: views are deltas, clicks citations, purchases usage, errors the end."""
    id_, kind = F.col("event_id"), F.col("event_type")
    type_ = F.when(kind == "view", "text_delta").when(kind == "click", "citation").when(kind == "purchase", "usage").otherwise("completed")
    cited = F.when(kind == "click", F.struct(F.lit("t").alias("title"), F.concat(F.lit("u"), (id_ % 5).cast("string")).alias("url")))
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), id_.alias("seq"), type_.alias("type"), F.concat(F.lit("d"), id_.cast("string")).alias("delta"), cited.alias("citation"),
        F.when(kind == "purchase", id_ % 100).alias("input_tokens"), F.when(kind == "purchase", id_ % 10).alias("output_tokens"),
        F.when(type_ == "completed", F.concat(F.lit("end"), (id_ % 3).cast("string"))).alias("finish_reason"), "ts",
    )
    return ev.fold(events).select(
        F.col("run_id").alias("user_id"), "n_events", "answer", "first_text_at", "usage.input_tokens", "usage.output_tokens", "finish_reason",
        F.array_join(F.transform("citations", lambda c: c["url"]), ",").alias("citations"),
    )


@query("""SELECT conv_id AS run_id, string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant') AS answer_raw, count(*) AS n_events FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') > 0""")
def answer_fold(spark, sf_dir):
    """AGG-15: assistant turns as text deltas of a run."""
    none = lambda t: F.lit(None).cast(t)
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", "text_delta").otherwise("note").alias("type"), F.col("text").alias("delta"),
        none("struct<title:string,url:string>").alias("citation"), none("bigint").alias("input_tokens"), none("bigint").alias("output_tokens"), none("string").alias("finish_reason"), none("timestamp_ntz").alias("ts"),
    )
    spoken = turns.where("type = 'text_delta'").select("run_id").distinct()
    return ev.fold(turns).join(spoken, "run_id", "left_semi").select("run_id", F.col("answer").alias("answer_raw"), "n_events")
