"""Thin queries over the training-data operators, with the parameters of production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, embedding_dedup, fill_in_middle, html_extraction, pii, quality, secrets, sentencepiece, sharding, simhash, spelling, suffix_dedup
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.simhash_components(docs, shingle=4, max_distance=4)
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "n_words", "similarity")


#: Bytes of text in a shard, few enough that small tables split several levels deep too.
SHARD_BYTES = 64 << 10


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.extendible_shards(table(spark, sf_dir, "documents"), limit_bytes=SHARD_BYTES)
    return shards.select(F.col("id").alias("doc_id"), "n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversized")


OP3_SQL = f"""
WITH r AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits
  FROM documents
), lv AS (
  SELECT d, bits >> (60 - d) AS p, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n
  FROM r, (SELECT unnest(range(0, 31)) AS d) GROUP BY 1, 2
), leaf AS (
  SELECT r.doc_id, min(lv.d) AS d FROM r JOIN lv ON lv.p = (r.bits >> (60 - lv.d))
  WHERE lv.b <= {SHARD_BYTES} OR lv.n = 1 GROUP BY 1
)
SELECT r.doc_id, r.n_bytes,
       CASE WHEN leaf.d = 0 THEN '' ELSE lpad(bin(r.bits >> (60 - leaf.d)), CAST(leaf.d AS INTEGER), '0') END AS shard,
       CAST(leaf.d AS INTEGER) AS depth, lv.b AS shard_bytes, lv.n AS shard_rows, lv.n = 1 AND lv.b > {SHARD_BYTES} AS oversized
FROM r JOIN leaf ON leaf.doc_id = r.doc_id JOIN lv ON lv.d = leaf.d AND lv.p = (r.bits >> (60 - leaf.d))
"""


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


#: A deployment passes its own; surrogates can't be linked between keys.
PII_KEY = "studylake example key"


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, key=PII_KEY, count_col="n_entities")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.secret_spans(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_conversations(turns))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The model of ``op8``, fitted to labels of rows that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    return quality.train(table(spark, sf_dir, "documents"), labels)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select(
        F.col("id").alias("doc_id"), quality.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    encoded = sentencepiece.encode(docs, carry=("text_sha256",), decoded=True)
    back = F.sha2("text", 256)
    return encoded.select(
        F.col("id").alias("doc_id"), F.size("piece_ids").cast("long").alias("n_pieces"), "n_fallback", F.xxhash64("piece_ids").alias("pieces_hash"),
        back.alias("decoded_sha256"), (back == F.col("text_sha256")).alias("round_trip"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        F.col("id").alias("doc_id"), F.length(back).cast("long").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extraction.extract(pages, html_extraction.train(pages), carry=("url",))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '</s>', '<\\/s>')"

#: The marks of a turn have 20 characters.
OP7_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id"""

#: Texts as hexadecimal strings, two characters a byte; windows of 50 bytes as groups.
OP9_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS k, md5(substr(h, 2 * i + 1, 100)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t WHERE length(h) >= 100)),
f AS (SELECT k, m, min(doc_id) AS d FROM w GROUP BY k, m HAVING min(doc_id) < max(doc_id)),
x AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.k = w.k AND f.m = w.m AND w.doc_id > f.d),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM x),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g),
r AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY doc_id, n),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT p.doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last,
  string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM p JOIN t ON t.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id"""


ALL = (op1_simhash_near_dedup, op2_benchmark_decontamination, op3_extendible_sharding, op4_embedding_near_dedup, op5_pii_surrogates, op6_secret_scan, op7_chat_formatting, op8_quality_classifier, op9_suffix_array_dedup, op10_sentencepiece, op11_spelling_variants, op12_fill_in_middle, op13_html_extraction)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_extendible_sharding": OP3_SQL, "op4_embedding_near_dedup": OP4_SQL, "op6_secret_scan": secrets.sql(), "op7_chat_formatting": OP7_SQL, "op9_suffix_array_dedup": OP9_SQL, "op11_spelling_variants": spelling.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_html_extraction": html_extraction.SQL}
