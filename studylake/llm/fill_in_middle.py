"""Fill-in-middle transformation: texts cut at unit ordinals into prefix, middle and suffix, and put together in another order.

Units are rows, not array steps: the matches of each text are exploded with their positions, windows sum the lengths of the
units before, cut requests are joined by unit ordinal, and the offsets found are aggregated for each text, which is then cut
with ``substring``. Units are exploded ``STRETCH`` at a time, so that a row stands for a stretch of units and not for one; the
few units between the start of a cut's stretch and the cut are counted where the text is cut. Whole texts are shuffled once.

Defined results: a null text counts as empty and a null id as an empty string in the digest that chooses the cuts; an empty
text, a text that holds a mark and a text chosen by ``plain_percent`` stay plain. Rows that repeat are each returned with the
same result; an empty table gives an empty result; further columns of the input, of any name, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, only

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Any code point; a unit pattern must match texts from end to end without gaps, as this or ``\\S+\\s*|\\s+`` does.
CODE_POINT = "(?s:.)"
#: Units in a row.
STRETCH = 512


def _draw(digest: Column, n: int) -> Column:
    """The ``n``-th group of eight hexadecimal digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * n - 7, 8), 16, 10).cast("long")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, plain_percent: int = 10, spm_percent: int = 20, seed: int = 1
) -> DataFrame:
    """``(id, n_units, form, prefix_chars, middle_chars, output)`` of every text.

    The sha256 of ``<seed>:<id>`` gives four numbers: two choose the cuts among the text's ``n_units + 1`` places between units,
    the third whether it stays plain, the fourth whether the suffix goes first (``spm``) or the prefix (``psm``).
    """
    scratch = Scratch(docs.sparkSession, "fim")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    # Equal rows share a key, which is what makes one set of offsets serve them all.
    key = F.unhex(F.sha2(F.concat_ws("\0", F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), 256))
    rows = only(docs, id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (_draw(digest, 3) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_draw(digest, 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("id", "text", digest.alias("digest"), form.alias("form"))

    # Every stretch but a text's last holds STRETCH units. The first carries the numbers that choose the cuts, null if plain.
    draws = [F.when(F.col("form") != "plain", _draw(F.col("digest"), n)).alias(f"draw{n}") for n in (1, 2)]
    several = rows.select(key.alias("key"), *draws, _matches(F.col("text"), f"(?:{unit}){{1,{STRETCH}}}").alias("found"))
    several = several.select("key", "draw1", "draw2", F.size("found").alias("many"), F.posexplode("found").alias("stretch", "said"))
    units = F.when(F.col("stretch") < F.col("many") - 1, STRETCH).otherwise(F.size(_matches(F.col("said"), unit)))
    draws = [F.when(F.col("stretch") == 0, F.col(d)).alias(d) for d in ("draw1", "draw2")]
    several = several.select("key", *draws, "stretch", units.cast("int").alias("units"), F.length("said").alias("chars"))
    several = several.repartition("key").dropDuplicates(["key", "stretch"])
    whole = Window.partitionBy("key")
    before = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    placed = scratch.write(
        several.select(
            "key", "draw1", "draw2", "stretch", "chars", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("unit_at"),
            F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char_at"), F.sum("units").over(whole).alias("n_units"),
        )
    )

    ends = [F.col(d) % (F.col("n_units") + 1) for d in ("draw1", "draw2")]
    cuts = F.explode(F.array(*(F.struct(F.lit(i).alias("cut"), pick(*ends).alias("ordinal")) for i, pick in enumerate((F.least, F.greatest)))))
    asked = placed.where("stretch = 0 AND draw1 IS NOT NULL").select("key", cuts.alias("c")).select("key", "c.cut", "c.ordinal")
    # The stretch that holds the last unit before a cut.
    asked = asked.withColumn("stretch", F.expr(f"CAST(greatest(ordinal - 1, 0) DIV {STRETCH} AS INT)"))
    met = asked.join(placed.select("key", "stretch", "chars", "unit_at", "char_at"), ["key", "stretch"])
    at = F.struct("char_at", "chars", (F.col("ordinal") - F.col("unit_at")).cast("int").alias("rest"))
    offsets = met.groupBy("key").agg(*(F.max(F.when(F.col("cut") == i, at)).alias(f"at{i}") for i in (0, 1)))
    counts = placed.where("stretch = 0").select("key", "n_units").join(offsets, "key", "left")

    def offset(at: Column) -> Column:
        within = F.substring("text", at["char_at"].cast("int") + 1, at["chars"].cast("int"))
        return at["char_at"].cast("int") + F.length(F.array_join(F.slice(_matches(within, unit), F.lit(1), at["rest"]), ""))

    joined = rows.withColumn("key", key).join(counts, "key", "left").select("id", "text", "form", "n_units", offset(F.col("at0")).alias("a"), offset(F.col("at1")).alias("b"))
    head, body, tail = F.substring("text", F.lit(1), F.col("a")), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")), F.substring("text", F.col("b") + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), body)
    spm = F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), body)
    return joined.select(
        "id", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "form", F.col("a").cast("long").alias("prefix_chars"),
        (F.col("b") - F.col("a")).cast("long").alias("middle_chars"), F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; its parts hold no marks, and no mark overlaps another, so each stands once."""
    after = lambda text, mark: F.substring_index(text, mark, -1)
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    body = after(output, MIDDLE)
    psm = F.concat(upto(after(output, PREFIX), SUFFIX), body, upto(after(output, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(output, PREFIX), MIDDLE), body, upto(after(output, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, length(t) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || x || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
