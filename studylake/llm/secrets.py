r"""Secret scans with multipart linking, in DataFrame operations alone.

Base findings stand by themselves, one kind for each pattern: ``assign`` (a credential's name, a separator and a value),
``access`` (an access key's identifier) and ``hex`` (a long run of hexadecimal digits). Multipart linking adds weak
candidates, each too common to report alone: identifiers (``id``: user, account or client names in an assignment, or short
access keys), secrets (``part``: short assigned values, or runs of just 40 base64 characters) and endpoints (``host``: URLs,
or hosts in an assignment). A weak candidate is reported only if a complementary part, of another of the three roles,
lies within ``scope`` code points of it in the same text. Base findings count as parts too: access keys are identifiers,
assigned values and hexadecimal runs are secrets.

Texts are read once; only spans are dealt. The interval join is a semi-join on text and position bucket, so pairs of
parts are never listed, and a bucket holds no more parts than fit into ``scope`` code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running
from .common import Scratch, only

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
WEAK_ID = r"""(?i)(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
WEAK_SECRET = r"[A-Za-z0-9+/=]{40,}"
WEAK_HOST = r"""(?i)(?:https?|jdbc:[a-z]+|ftp|s3|ssh)://[^\x20\x09-\x0D"'<>]+|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,}"""

#: Base kinds in the order that settles equal starts.
KINDS = ("assign", "access", "hex", "id", "part", "host")
ROLE = {"assign": 2, "access": 1, "hex": 2, "id": 1, "part": 2, "host": 4}
SPAN = "struct<start:bigint,rank:int,end:bigint>"


def _spans(text: Column, pattern: str, kind) -> Column:
    """Spans (code points) of a pattern's leftmost matches that do not overlap, each of the kind ``kind(match)``.

    The text between matches gives their positions: a match starts after all pieces and matches before it.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.zip_with(
        pieces,
        found,
        lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("size"), F.when(m.isNotNull(), kind(m)).alias("rank")),
    )
    span = lambda x, at: F.when(
        x["rank"].isNotNull(), F.struct((at + x["gap"]).alias("start"), x["rank"].alias("rank"), (at + x["gap"] + x["size"]).alias("end"))
    )
    spans = running(each, lambda x: x["gap"] + x["size"], span, SPAN)
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _kind(name: str) -> Column:
    return F.lit(KINDS.index(name))


def _value_length(match: Column) -> Column:
    return F.length(F.regexp_replace(match, VALUE, ""))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, scope: int = 400) -> DataFrame:
    """Secrets of every row: ``(id, base, linked)``, arrays of ``(start, rank, end)`` sorted by start, then kind.

    ``base`` holds the base findings, ``linked`` the weak candidates with a complementary part within ``scope``; ``rank``
    is the kind's place in ``KINDS``, offsets are code points, ends exclusive. One row comes out for each row of ``docs``,
    repeated rows and null ids included; a null text is empty. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    source = only(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    assigned = source.select(
        "id",
        F.when(F.rlike(text, F.lit("AKIA|://|[:=]|[0-9a-f]{16}|[A-Za-z0-9+/]{40}")), text).otherwise("").alias("text"),
    )
    scanned = assigned.select(
        "id",
        F.when(text == "", 0).otherwise(F.xxhash64("text")).alias("h"),
        F.concat(
            _spans(text, ASSIGN, lambda m: F.when(_value_length(m) >= 12, _kind("assign")).otherwise(_kind("part"))),
            _spans(text, ACCESS, lambda m: F.when(F.length(m) >= 18, _kind("access")).otherwise(_kind("id"))),
            _spans(text, HEX, lambda m: _kind("hex")),
            _spans(text, WEAK_ID, lambda m: _kind("id")),
            _spans(text, WEAK_SECRET, lambda m: F.when((F.length(m) == 40) & ~m.contains("="), _kind("part"))),
            _spans(text, WEAK_HOST, lambda m: _kind("host")),
        ).alias("all"),
    )
    strong = lambda s: s["rank"] < KINDS.index("id")
    found = scratch.write(
        scanned.select("id", "h", F.array_sort(F.filter("all", strong)).alias("base"), F.filter("all", lambda s: ~strong(s)).alias("weak"))
    )
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("s.rank") + 1)
    parts = found.where(F.size("weak") > 0).select("id", "h", F.explode(F.array_distinct(F.concat("weak", "base"))).alias("s"))
    parts = parts.select("id", "h", "s", role.alias("role")).distinct()
    weak = parts.where(F.col("s.rank") >= KINDS.index("id")).select(
        "id", "h", "s", "role", F.explode(F.sequence(F.floor((F.col("s.start") - scope) / scope), F.floor((F.col("s.end") + scope) / scope))).alias("at")
    )
    # A part stands in every bucket that it covers, a weak one asks in every bucket within scope.
    other = parts.select(
        F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("s").alias("t"), F.col("role").alias("role2"),
        F.explode(F.sequence(F.floor(F.col("s.start") / scope), F.floor(F.col("s.end") / scope))).alias("at2"),
    )
    near = (
        F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("at") == F.col("at2")) & (F.col("role") != F.col("role2"))
        & (F.col("t.start") <= F.col("s.end") + scope) & (F.col("t.end") >= F.col("s.start") - scope)
    )
    linked = weak.join(other, near, "left_semi").groupBy("id", "h").agg(F.array_sort(F.collect_set("s")).alias("linked"))
    linked = scratch.write(linked)
    none = F.array().cast(f"array<{SPAN}>")
    alone = found.where(F.size("weak") == 0).select("id", "base", none.alias("linked"))
    some = found.where(F.size("weak") > 0).alias("f").join(
        linked.alias("l"), F.col("f.id").eqNullSafe(F.col("l.id")) & (F.col("f.h") == F.col("l.h")), "left"
    )
    return alone.unionByName(some.select("f.id", "base", F.coalesce("linked", none).alias("linked")))


def report(spans: DataFrame) -> DataFrame:
    """Counts, digest and listing of ``secret_spans``' rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    return spans.select(
        "id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def sql(scope: int = 400) -> str:
    """DuckDB SQL of ``report`` over ``documents``: matches and the text between them by list functions, links by a join."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    value = f"length(regexp_replace(m, {quote(VALUE)}, ''))"
    rules = [
        ("assign", ASSIGN, f"{value} >= 12"), ("access", ACCESS, "length(m) >= 18"), ("hex", HEX, "true"),
        ("id", WEAK_ID, "true"), ("id", ACCESS, "length(m) < 18"),
        ("part", ASSIGN, f"{value} < 12"), ("part", WEAK_SECRET, "length(m) = 40 AND m NOT LIKE '%=%'"), ("host", WEAK_HOST, "true"),
    ]
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {KINDS.index(kind)} AS rank, {ROLE[kind]} AS role, s AS start, s + length(m) AS stop FROM (
          SELECT doc_id, f[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s
          FROM (SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, {quote(p)}) AS f, string_split_regex(text, {quote(p)}) AS g FROM documents WHERE regexp_matches(text, {quote(p)})))
        ) WHERE {keep}"""
        for kind, p, keep in rules
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    item = f"{names}[rank + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    base = KINDS.index("id")
    return f"""
WITH p AS (SELECT DISTINCT * FROM ({found})), l AS (
  SELECT DISTINCT a.* FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.role <> b.role
    AND b.start <= a.stop + {scope} AND b.stop >= a.start - {scope} WHERE a.rank >= {base}
), s AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg({item}, ',' ORDER BY start, rank) FILTER (WHERE rank < {base}) AS base, string_agg({item}, ',' ORDER BY start, rank, stop) AS spans,
    count(*) FILTER (WHERE rank >= {base}) AS n_linked
  FROM (SELECT * FROM p WHERE rank < {base} UNION ALL SELECT * FROM l) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""
