"""Study artifacts: saving by kind, listing, validation, truncation, structured contracts, diagram layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

SINGLETONS = ("tldr", "half-page", "visual-recap")
LAYOUTS = ("flow", "tree", "timeline", "comparison", "cycle")
#: A bullet as ``^\s*[-*]`` of browsers finds it, with their line ends and white space, which differ between engines.
BULLET = rf"(?:^|[\n\r\u2028\u2029]){tx.SPACE}*[-*]"
DIAGRAM = "version int, title string, layout string, nodes array<struct<id:string,label:string,detail:string,sourceRefs:array<string>>>, edges array<struct<from:string,to:string,label:string>>"
RECAP = "title string, sections array<struct<heading:string,points:array<string>>>"


def save(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Artifacts after saving (ART-1): singleton kinds overwrite their newest version, others get the next ones.

    Both tables have kind, scope_type, scope_id, version, content; ``new``'s version is ignored, and ``order`` tells which
    of several new artifacts of a scope comes first.
    """
    key = ["kind", "scope_type", "scope_id"]
    single = F.col("kind").isin(*SINGLETONS)
    top = stored.groupBy(*key).agg(F.max("version").alias("top"))
    w = Window.partitionBy(*key).orderBy(order)
    placed = new.drop("version").join(top, key, "left").withColumn("n", F.row_number().over(w)).withColumn("back", F.row_number().over(w.orderBy(F.col(order).desc())))
    placed = placed.where(~single | (F.col("back") == 1))
    version = F.when(single, F.coalesce("top", F.lit(1))).otherwise(F.coalesce("top", F.lit(0)) + F.col("n")).cast("long")
    fresh = placed.withColumn("version", version).select(*stored.columns)
    kept = stored.join(fresh.where(single).select(*key, "version"), [*key, "version"], "left_anti")
    return kept.select(*stored.columns).unionByName(fresh)


def word_count(text: Column) -> Column:
    return F.size(tx.words(text)).cast("long")


def problems(kind: Column, text: Column) -> Column:
    """What is wrong with a text artifact; an empty array if nothing is (ART-3)."""
    n, bullets = word_count(text), F.regexp_count(text, F.lit(BULLET))
    rule = lambda wrong, name: F.when(wrong, F.lit(name))
    found = F.array(
        rule(F.coalesce(F.trim(text), F.lit("")) == "", "text is required"),
        rule((kind == "tldr") & (n > 150), "more than 150 words"),
        rule((kind == "tldr") & (bullets > 5), "more than 5 bullets"),
        rule((kind == "half-page") & ~n.between(300, 450), "not 300 to 450 words"),
    )
    return F.array_compact(found)


def truncate(text: Column, most: int = 150) -> Column:
    """The first words and an ellipsis, or the text as it is (ART-4)."""
    words = tx.words(text)
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, F.lit(1), F.lit(most)), " "), F.lit("…"))).otherwise(text)


def unfence(text: Column) -> Column:
    """A JSON answer without its code fence (ART-5)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def valid_json(text: Column) -> Column:
    return F.try_parse_json(unfence(text)).isNotNull()


def diagram_problems(json: Column) -> Column:
    """Breaches of the diagram contract (ART-6)."""
    d = F.from_json(json, DIAGRAM)
    ids = F.transform(d["nodes"], lambda n: n["id"])
    rule = lambda wrong, name: F.when(F.coalesce(wrong, F.lit(True)), F.lit(name))
    return F.array_compact(
        F.array(
            rule(d["title"].isNull() | (d["title"] == ""), "title"),
            rule(~d["layout"].isin(*LAYOUTS), "layout"),
            rule(~F.size(d["nodes"]).between(1, 24), "nodes"),
            rule(F.coalesce(F.size(d["edges"]), F.lit(0)) > 40, "edges"),
            rule(~F.forall(ids, lambda i: F.rlike(i, F.lit(r"^[A-Za-z0-9_-]{1,64}$"))), "node id"),
        )
    )


def recap_problems(json: Column) -> Column:
    """Breaches of the visual recap's contract (ART-7)."""
    d = F.from_json(json, RECAP)
    rule = lambda wrong, name: F.when(F.coalesce(wrong, F.lit(True)), F.lit(name))
    return F.array_compact(F.array(rule(d["title"].isNull() | (d["title"] == ""), "title"), rule(~F.size(d["sections"]).between(1, 6), "sections")))


def layout_nodes(diagrams: DataFrame, key: str, nodes: str = "nodes") -> DataFrame:
    """``(key, id, x, y)``: two columns of nodes (ART-8)."""
    each = diagrams.select(key, F.posexplode(nodes).alias("i", "n"))
    return each.select(key, F.col("n.id").alias("id"), (80 + 170 * (F.col("i") % 2)).cast("long").alias("x"), (45 + 85 * F.floor(F.col("i") / 2)).cast("long").alias("y"))


def layout_edges(diagrams: DataFrame, key: str, nodes: str = "nodes", edges: str = "edges") -> DataFrame:
    """``(key, from, to, x1, y1, x2, y2)`` of edges whose ends both exist (ART-8)."""
    at = layout_nodes(diagrams, key, nodes)
    ends = lambda name, i: at.select(key, F.col("id").alias(name), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    each = diagrams.select(key, F.explode(edges).alias("e")).select(key, F.col("e.from").alias("from"), F.col("e.to").alias("to"))
    return each.join(ends("from", 1), [key, "from"]).join(ends("to", 2), [key, "to"])


def image_ids(contents: Column) -> Column:
    """Generated images that an artifact's JSON refers to (AGG-18)."""
    return F.array_distinct(F.regexp_extract_all(contents, F.lit(r'"imageId"\s*:\s*"([A-Za-z0-9_-]+)"'), F.lit(1)))
