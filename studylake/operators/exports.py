"""Exports of study notes: placement, Markdown with footnotes, embedded assets, whole-library manifests, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .relational import numbered

INLINE, FOOTNOTE = 400, 1200
DEFAULT_NOTE = "Highlighted without a note."


def placement(note: Column) -> Column:
    """Where a note goes by its length (EX-3)."""
    n = F.length(note)
    return F.when(n <= INLINE, "inline").when(n <= FOOTNOTE, "footnote").otherwise("appendix")


def footnotes(notes: DataFrame, key: str, order: str, quote: str, note: str) -> DataFrame:
    """``(key, ordinal, line)``: numbered footnotes of each document, a sentence where the note is empty (EX-4)."""
    body = tx.or_else(F.col(note), F.lit(DEFAULT_NOTE))
    line = F.concat(F.lit("[^"), F.col("ordinal").cast("string"), F.lit("]: "), body)
    marked = F.concat(F.lit("> "), F.col(quote), F.lit(" [^"), F.col("ordinal").cast("string"), F.lit("]"))
    return numbered(notes, key, order, "ordinal").select(key, "ordinal", line.alias("line"), marked.alias("quote"))


def notebook(notes: DataFrame, key: str, order: str, quote: str, note: str) -> DataFrame:
    """``(key, markdown)``: quotes, then their footnotes (EX-4)."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "quote", "line")))
    part = lambda f: F.array_join(F.transform(rows, lambda r: r[f]), "\n\n" if f == "quote" else "\n")
    return footnotes(notes, key, order, quote, note).groupBy(key).agg(F.concat(part("quote"), F.lit("\n\n"), part("line")).alias("markdown"))


def notebook_lines(documents: DataFrame, notes: DataFrame, artifacts: DataFrame, messages: DataFrame) -> DataFrame:
    """``(document_id, section, at, part, line)``: a whole Markdown notebook as rows, in the order of section, at and part (EX-4).

    ``documents``: document_id, title, source_name; ``notes``: document_id, at, quote, note; ``artifacts``: document_id, at,
    kind, content, source_refs; ``messages``: document_id, at, role, content; ``at`` orders the rows of a document. Sections
    without rows have no heading. Lines stay rows: nothing of a document is gathered before a sink streams them.
    """

    def lines(rows: DataFrame, section: int, at: Column, *parts: Column) -> DataFrame:
        each = F.array(*(F.struct(F.lit(i).alias("part"), p.cast("string").alias("line")) for i, p in enumerate(parts)))
        return rows.select("document_id", F.lit(section).alias("section"), at.cast("long").alias("at"), F.explode(each).alias("l")).select("document_id", "section", "at", "l.part", "l.line")

    text = lambda *values: F.concat(*(F.coalesce(v, F.lit("")) if not isinstance(v, str) else F.lit(v) for v in values))
    blank, first = F.lit(""), F.lit(-1)
    head = lines(documents, 0, first, text("# ", F.col("title")), blank, text("Source: ", F.col("source_name")), blank, F.lit("## Checked highlights"), blank)
    marks = numbered(notes, "document_id", "at", "ordinal")
    number = F.col("ordinal").cast("string")
    quotes = lines(marks, 1, F.col("ordinal"), text("> ", F.col("quote"), "[^", number, "]"), blank)
    ends = lines(marks, 4, F.col("ordinal"), text("[^", number, "]: ", tx.or_else(F.col("note"), F.lit(DEFAULT_NOTE))))
    titled = lambda rows, section, title: lines(rows.select("document_id").distinct(), section, first, F.lit(title), blank)
    made = lines(artifacts, 2, F.col("at"), text("### ", F.col("kind")), F.coalesce("content", F.lit("")), blank, text("Sources: ", F.array_join("source_refs", ", ")), blank)
    said = lines(messages, 3, F.col("at"), text("**", F.col("role"), ":** ", F.col("content")), blank)
    out = head
    for more in (quotes, titled(artifacts, 2, "## Promoted artifacts"), made, titled(messages, 3, "## Discussion appendix"), said, ends):
        out = out.unionByName(more)
    return out


#: How a page or a style sheet names an asset.
REFERENCE = r"asset:([A-Za-z0-9_-]+)"


def with_references(text: Column, uris: Column) -> Column:
    """A text with the assets that it names put in from a map; names are taken whole, and unknown ones stay."""
    parts, names = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    put = lambda i: F.coalesce(F.try_element_at(uris, F.get(names, i)), F.concat(F.lit("asset:"), F.get(names, i)), F.lit(""))
    return F.array_join(F.transform(parts, lambda part, i: F.concat(part, put(i))), "")


def embed_assets(pages: DataFrame, assets: DataFrame, key: str, html: str) -> DataFrame:
    """HTML with its asset ids replaced by data URIs (EX-2, SRC-9).

    ``assets``: key, asset_id (unique in a page), mime, content. Assets of a page meet in its row; references are
    ``asset:<id>``. Style sheets come after all others and in the order of their ids: each gets the URIs of the assets that it
    names, earlier style sheets among them, before it is encoded itself.
    """
    encoded = lambda content: F.regexp_replace(F.base64(content), r"\s", "")
    style = F.col("mime") == "text/css"
    entry = F.struct("asset_id", F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), encoded(F.col("content"))).alias("uri"))
    listed = assets.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(~style, entry))).alias("__plain"),
        F.array_sort(F.collect_list(F.when(style, F.struct("asset_id", F.decode("content", "UTF-8").alias("text"))))).alias("__styles"),
    )

    def add(known: Column, sheet: Column) -> Column:
        body = F.encode(with_references(sheet["text"], known), "UTF-8")
        return F.map_concat(known, F.create_map(sheet["asset_id"], F.concat(F.lit("data:text/css;base64,"), encoded(body))))

    uris = F.aggregate(F.col("__styles"), F.col("__plain"), add)
    joined = pages.join(listed, key, "left").withColumn(html, F.when(F.col("__plain").isNull(), F.col(html)).otherwise(with_references(F.col(html), uris)))
    return joined.drop("__plain", "__styles")


def without_scripts(html: Column) -> Column:
    """HTML without its scripts (EX-1)."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", "")


def export_data(documents: DataFrame, versions: DataFrame, highlights: DataFrame, artifacts: DataFrame, assets: DataFrame | None = None, transcript: DataFrame | None = None, revisions: DataFrame | None = None) -> DataFrame:
    """Newest version of each document with checked highlights by offset and promoted artifacts by time (EX-1).

    Where ``versions`` has ``html``, it comes without scripts and, with ``assets`` (version_id, asset_id, mime, content), with
    these embedded. ``revisions`` (version_id, revision and any of canonical_text and html) are its edits: the newest one stands
    for the version. ``transcript`` (document_id, created_at, role, content) adds the messages of the discussions in order.
    """
    values = [c for c in ("version", "version_id", "canonical_text", "html") if c in versions.columns]
    newest = versions.groupBy("document_id").agg(F.max_by(F.struct(*values), "version").alias("v"))
    notes = highlights.where("checked").groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "exact_quote", "note"))).alias("highlights"))
    kept = artifacts.where("promoted").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "kind", "content"))).alias("artifacts"))
    out = documents.join(newest, "document_id").select(*documents.columns, *(f"v.{c}" for c in values))
    if revisions is not None:
        edited = [c for c in ("canonical_text", "html") if c in values and c in revisions.columns]
        newer = revisions.groupBy("version_id").agg(F.max_by(F.struct(*edited), "revision").alias("__edit"))
        out = out.join(newer, "version_id", "left")
        out = out.select(*(F.coalesce(F.col(f"__edit.{c}"), F.col(c)).alias(c) if c in edited else F.col(c) for c in out.columns if c != "__edit"))
    if "html" in values:
        out = out.withColumn("html", without_scripts(F.col("html")))
        out = out if assets is None else embed_assets(out, assets, "version_id", "html")
    out = out.join(notes, "version_id", "left").join(kept, "document_id", "left")
    if transcript is None:
        return out
    said = transcript.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "role", "content"))).alias("transcript"))
    return out.join(said, "document_id", "left")


def library(exported: DataFrame, key: str, title: str, html: str = "html") -> DataFrame:
    """``(key, filename, html)``: a page for each exported document under a name of its own (SNK-12)."""
    return unique_names(exported, key, title).select(key, "filename", html)


def log_exports(history: DataFrame, exported: DataFrame, fmt: str, at: Column) -> DataFrame:
    """The history of exports with new rows (SNK-11): document_id, format, created_at."""
    return history.unionByName(exported.select("document_id", F.lit(fmt).alias("format"), at.alias("created_at")))


def manifest(exported: DataFrame, fields: list[str], name: str = "documents") -> DataFrame:
    """Lines of a library's manifest, one document each, and a last one with their count (SNK-12).

    A manifest in one JSON object would gather the library in one task; lines are written where the documents are.
    """
    lines = exported.select(F.to_json(F.struct(*fields)).alias("line"))
    return lines.unionByName(exported.agg(F.to_json(F.struct(F.count("*").alias(f"{name}_count"))).alias("line")))


def unique_names(documents: DataFrame, key: str, title: str, suffix: str = ".html", normalize: bool = True) -> DataFrame:
    """File names that differ even where titles agree: all but the first key's carry their key (HTM-14, SNK-12).

    The first keys are joined by key, not by title, so that documents of one title don't meet in a task.
    """
    named = documents.withColumn("stem", tx.file_stem(F.col(title), normalize=normalize))
    first = named.groupBy(F.lower("stem").alias("__stem")).agg(F.min(key).alias("__first")).select("__first")
    joined = named.join(first, F.col(key) == F.col("__first"), "left")
    tail = F.when(F.col("__first").isNull(), F.concat(F.lit("-"), F.col(key).cast("string"))).otherwise("")
    return joined.withColumn("filename", F.concat("stem", tail, F.lit(suffix))).drop("__first", "stem")


def thread_label(quote: Column, title: Column, default: str = "Discussion") -> Column:
    """A thread's label: its quote, else its title (EX-7)."""
    return tx.or_else(quote, title, F.lit(default))


def edit_label(summary: Column) -> Column:
    """A summary of operation counts as text, by name (EX-7)."""
    each = F.transform(F.array_sort(F.map_entries(summary)), lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"]))
    return F.array_join(each, ", ")


def plain_markdown(text: Column) -> Column:
    """Markdown for display: raw HTML dropped, images as their text (EX-8)."""
    named = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "[image: $1]")
    return F.regexp_replace(named, r"</?[A-Za-z][^>]*>", "")
