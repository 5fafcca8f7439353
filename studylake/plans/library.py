"""Library, version and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import relational as rel
from ..operators import store
from .registry import query, read


@query("""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS version,
  row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS back FROM documents),
c AS (SELECT d.source, d.lang, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 GROUP BY 1, 2)
SELECT v.doc_id, v.source AS group_name, CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_estimate, coalesce(c.n, 0) AS checked_count, v.version
FROM v LEFT JOIN c ON c.source = v.source AND c.lang = v.lang WHERE back = 1""")
def library_shelf(spark, sf_dir):
    """JN-4, JN-6, AGG-1, SRT-1, PRJ-1 (a row's columns with computed ones): newest version of each article with the checked
    labels of all its versions. Documents of one
    source and language are an article's versions; the version number is their count, so no text is sorted or numbered."""
    docs, labels = read(spark, sf_dir, "documents", "labels")
    keys = ["source", "lang"]
    newest = docs.groupBy(*keys).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("version"))
    marked = labels.where("quality = 1").select("doc_id").join(docs.select("doc_id", *keys), "doc_id")
    checked = marked.groupBy(*keys).agg(F.count("*").alias("checked_count"))
    shelf = newest.join(docs.select("doc_id", tx.token_estimate(F.col("text")).alias("token_estimate")), "doc_id").join(checked, keys, "left")
    return shelf.select(
        "doc_id", F.col("source").alias("group_name"), "token_estimate", F.coalesce("checked_count", F.lit(0)).alias("checked_count"), "version"
    ).orderBy(F.col("doc_id").desc())


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_version_per_key(spark, sf_dir):
    """JN-4, JN-10, JN-15."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rel.newest(orders, ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey").desc())


@query("""SELECT c_custkey, coalesce(max(o_orderkey), 0) AS revision, coalesce(max_by(o_orderstatus, o_orderkey), 'original') AS path
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def latest_or_default_left(spark, sf_dir):
    """JN-5, PRJ-2, ED-10: newest revision or the original."""
    customer, orders = read(spark, sf_dir, "customer", "orders")
    right = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("path"))
    return rel.newest_or_default(customer.select("c_custkey"), right, "c_custkey", "o_orderkey", {"path": F.lit("original")})


@query("""SELECT n_name, count(s_suppkey) AS document_count FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def group_counts_with_zero(spark, sf_dir):
    """JN-9, AGG-2, SRT-2."""
    nation, supplier = read(spark, sf_dir, "nation", "supplier")
    found = rel.counts_with_zero(nation.select("n_nationkey", "n_name"), supplier, "n_nationkey", "s_nationkey", "document_count")
    return found.select("n_name", "document_count").orderBy(tx.lower_ascii(F.col("n_name")), "n_name")


@query("""SELECT c_custkey, c_name, coalesce(n, 0) AS checked_count FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def checked_count_correlated(spark, sf_dir):
    """AGG-1, FLT-1."""
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return rel.count_per_row(customer.select("c_custkey", "c_name"), orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "checked_count", F.col("o_orderstatus") == "F")


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS version FROM orders),
m AS (SELECT *, max(version) OVER (PARTITION BY o_custkey, o_orderpriority) AS top FROM v)
SELECT o_orderkey, o_orderpriority, version FROM m WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR version = top""")
def singleton_or_all_artifacts(spark, sf_dir):
    """FLT-2, FLT-3, ART-2."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    keys = ["o_custkey", "o_orderpriority"]
    versions = orders.withColumn("version", F.row_number().over(rel.Window.partitionBy(*keys).orderBy("o_orderkey")).cast("long"))
    return rel.all_or_newest(versions, keys, "version", "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority", "version")


@query("""SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'""")
def three_way_inner(spark, sf_dir):
    """JN-1, JN-2, JN-11, JN-12, JN-13, JN-16, FLT-10."""
    supplier, nation, region = read(spark, sf_dir, "supplier", "nation", "region")
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.where(F.col("r_name") != "ASIA").select("s_suppkey", "n_name", "r_name")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT i.l_orderkey, i.l_linenumber, n, count(*) AS shipped FROM lineitem i JOIN l ON l.l_orderkey = i.l_orderkey AND l.l_linenumber = i.l_linenumber
WHERE i.l_linestatus = 'F' GROUP BY 1, 2, 3""")
def composite_key_join(spark, sf_dir):
    """JN-3, JN-14: a join on two columns. Both sides are one row a pair, so repeats cannot multiply."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    pair = ["l_orderkey", "l_linenumber"]
    shipped = lines.where("l_linestatus = 'F'").groupBy(*pair).agg(F.count("*").alias("shipped"))
    return lines.groupBy(*pair).agg(F.count("*").alias("n")).join(shipped, pair)


@query("""SELECT conv_id, turn, (SELECT string_agg(b.text, chr(10) ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1) AS neighbor_text FROM conversations a""")
def neighbor_window(spark, sf_dir):
    """JN-17, FLT-4, AGG-13, CTX-4."""
    turns = read(spark, sf_dir, "conversations")
    return rel.neighbours(turns, "conv_id", "turn", "text", "neighbor_text").select("conv_id", "turn", "neighbor_text")


@query("""SELECT c_custkey AS o_custkey, coalesce(max(o_orderkey), 0) + 1 AS next_version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def next_version(spark, sf_dir):
    """AGG-5, ART-1: order numbers as versions, with gaps."""
    customer, orders = read(spark, sf_dir, "customer", "orders")
    return rel.next_version(customer.select(F.col("c_custkey").alias("o_custkey")), orders, "o_custkey", "o_orderkey")


@query("""SELECT conv_id, count(*) AS n_messages, '[' || string_agg('{"turn":' || turn || ',"role":' || to_json(role) || ',"content":' || to_json(text) || '}', ',' ORDER BY turn) || ']' AS messages FROM conversations GROUP BY conv_id""")
def thread_json_aggregate(spark, sf_dir):
    """AGG-7, JSON: a thread's messages in order as a JSON array of objects."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return rel.messages_json(turns, "conv_id", "turn", ["turn", "role", "content"])


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def thread_first_action(spark, sf_dir):
    """AGG-8, SRT-7."""
    return rel.first_value(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id")


@query("""SELECT event_type, round(avg(value), 6) AS avg_ttft FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY event_type""")
def ttft_avg_by_model(spark, sf_dir):
    """AGG-4, FLT-5, FLT-10."""
    return rel.mean_where(read(spark, sf_dir, "events"), "event_type", "value", "avg_ttft", F.col("event_type") != "error")


def _accounts(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return customer.where("c_custkey % 2 = 0"), customer.where("c_custkey % 3 = 0")


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def upsert_merge(spark, sf_dir):
    """SNK-3, SNK-5: even customers are stored; each third one arrives anew."""
    stored, source = _accounts(spark, sf_dir)
    return store.upsert(stored, source.withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("""SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def insert_or_ignore(spark, sf_dir):
    """SNK-2."""
    stored, source = _accounts(spark, sf_dir)
    return store.insert_or_ignore(stored, source.withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 12 <> 0 THEN 'new' WHEN c_custkey % 2 = 0 THEN 'old' END AS last_ref FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def keep_old_if_null(spark, sf_dir):
    """SNK-4: a null reference leaves the stored one."""
    stored, source = _accounts(spark, sf_dir)
    new = source.select("c_custkey", F.when(F.col("c_custkey") % 12 != 0, "new").alias("last_ref"))
    return store.upsert(stored.select("c_custkey", F.lit("old").alias("last_ref")), new, "c_custkey", keep_old_if_null=("last_ref",))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def partial_patch(spark, sf_dir):
    """SNK-7, ART-9: unset fields stay, set nulls clear."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    fifth, third = F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 3 == 0
    changes = customer.where(third | fifth).select(
        "c_custkey", F.when(~fifth, F.concat(F.upper("c_mktsegment"), F.lit("!"))).alias("c_mktsegment"), F.lit(True).alias("c_mktsegment_set"),
        F.lit(0.0).alias("c_acctbal"), (third & ~fifth).alias("c_acctbal_set"),
    )
    return store.patch(customer, changes, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""WITH n AS (SELECT * FROM nation WHERE n_nationkey > 4), c AS (SELECT * FROM customer WHERE c_nationkey > 4),
o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <= 4)),
l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <= 4))
SELECT 'nation' AS table_name, count(*) AS remaining FROM n UNION ALL SELECT 'customer', count(*) FROM c
UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def cascade_delete(spark, sf_dir):
    """SNK-8."""
    names = ["nation", "customer", "orders", "lineitem"]
    tables = dict(zip(names, read(spark, sf_dir, *names)))
    links = [("nation", "n_nationkey", "customer", "c_nationkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")]
    gone = tables["nation"].where("n_nationkey <= 4").select("n_nationkey")
    left = store.cascade_delete(tables, "nation", gone, links)
    counts = [left[n].agg(F.lit(n).alias("table_name"), F.count("*").alias("remaining")) for n in names]
    return rel.reduce(lambda a, b: a.unionByName(b), counts)


@query("""SELECT s_suppkey, CASE WHEN s_nationkey <> 3 THEN s_nationkey END AS s_nationkey FROM supplier""")
def group_delete_set_null(spark, sf_dir):
    """SNK-9."""
    supplier, nation = read(spark, sf_dir, "supplier", "nation")
    return store.set_null_on_delete(supplier.select("s_suppkey", "s_nationkey"), nation.where("n_nationkey <> 3"), "s_nationkey", "n_nationkey")


@query("""SELECT count(*) AS members FROM supplier WHERE s_nationkey = 3""")
def group_member_count(spark, sf_dir):
    """AGG-3."""
    return read(spark, sf_dir, "supplier").where("s_nationkey = 3").agg(F.count("*").alias("members"))


@query("""WITH old AS (SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source FROM documents),
new AS (SELECT DISTINCT doc_id, 'quality' || quality AS tag FROM labels),
t AS (SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT * FROM new)
SELECT doc_id, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS tags FROM t GROUP BY doc_id""")
def tag_replace(spark, sf_dir):
    """SNK-6: labelled documents get their label as the only tag."""
    docs, labels = read(spark, sf_dir, "documents", "labels")
    old = docs.select("doc_id", F.explode(F.array("lang", "source")).alias("tag"))
    new = labels.select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string")).alias("tag"))
    return store.joined_children(store.replace_children(old, new, "doc_id"), "doc_id", "tag", "tags")


@query("""SELECT user_id, count(*) AS live FROM events WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-14 00:00:00' GROUP BY user_id""")
def session_purge(spark, sf_dir):
    """SNK-10, FLT-8, TIME: sessions last 30 days; the present is a parameter."""
    sessions = read(spark, sf_dir, "events").withColumn("expires", store.expiry(F.col("ts")))
    left = store.purge(sessions, "expires", F.lit("2024-02-14 00:00:00").cast("timestamp_ntz"))
    return left.groupBy("user_id").agg(F.count("*").alias("live"))


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS canonical_doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def content_hash_dedup(spark, sf_dir):
    """HTM-9: identical bytes anywhere give the first document."""
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("canonical_doc_id"), F.count("*").alias("copies"))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents""")
def dedup_versions(spark, sf_dir):
    """HTM-9: each import with the document that it resolves to. Joined to an aggregate, so a popular text is no large window."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_doc_id"))
    return docs.join(first, "h").select("doc_id", "first_doc_id", (F.col("doc_id") != F.col("first_doc_id")).alias("duplicate"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority ILIKE '%high%'
AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') >= '1993-01-01' AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') <= '1996-12-31'""")
def optional_filters(spark, sf_dir):
    """FLT-2, FLT-6, FLT-7, FLT-9: predicates for the parameters that were given."""
    orders = read(spark, sf_dir, "orders")
    given = {"status": ["F", "O"], "tag": "high", "from": "1993-01-01", "to": "1996-12-31", "document": ""}
    rules = {
        "status": lambda v: F.col("o_orderstatus").isin(v), "tag": lambda v: F.col("o_orderpriority").ilike(f"%{v}%"),
        "from": lambda v: rel.range_strings("o_orderdate", v, None), "to": lambda v: rel.range_strings("o_orderdate", None, v),
        "document": lambda v: F.col("o_orderkey") == v,
    }
    return rel.filtered(orders, given, rules).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def existence_probe(spark, sf_dir):
    """FLT-12, ANC-9."""
    customer, orders = read(spark, sf_dir, "customer", "orders")
    live = orders.where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return rel.existing(customer.select("c_custkey", "c_name"), live, ["c_custkey"])


@query("""SELECT s_suppkey, CASE WHEN r_regionkey IS NULL THEN 'Ungrouped' ELSE n_name END AS group_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'EUROPE'""")
def shelf_buckets(spark, sf_dir):
    """JN-6, JN-7, JN-8, JN-21: members of known groups, and the rest."""
    supplier, nation, region = read(spark, sf_dir, "supplier", "nation", "region")
    known = nation.join(region.where("r_name <> 'EUROPE'"), nation.n_regionkey == region.r_regionkey, "left_semi")
    return rel.grouped_or_rest(supplier, known.select("n_nationkey", F.col("n_name").alias("group_name")), "s_nationkey", "n_nationkey", "group_name", "Ungrouped").select("s_suppkey", "group_name")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_three_per_key(spark, sf_dir):
    """SRT-3, SRT-4, SRT-8: a top-k report with a unique tie-break."""
    w = rel.Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@query("""SELECT user_id, ts FROM (SELECT DISTINCT user_id, max(ts) OVER (PARTITION BY user_id) AS ts FROM events)""")
def last_seen(spark, sf_dir):
    """SRC-1, SRC-2: newest value per key."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
