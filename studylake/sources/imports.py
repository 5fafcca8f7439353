"""Imports of pages and archives: what each source is, which page it gives, and which document that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .assets import choose_entry, import_kind, read_archives


def import_sources(sources: DataFrame, stored: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``(path, kind, entry, choices, error, document_id, duplicate)`` of sources (SRC-3 with SRC-4, SRC-5 and HTM-9).

    ``sources``: path, name, content; ``stored``: content_hash and document_id of the pages known so far, each hash once;
    ``chosen``: path and entry where a reader picked a page of an archive. A source that is no page or archive, breaks a limit
    or holds an unsafe entry has an ``error``; an archive of several pages has ``choices`` and no document. Equal bytes are one
    document: the stored one, else that of the first path, whose id follows from its bytes; the others are duplicates.
    """
    named = sources.select("path", "content", import_kind(F.col("name"), F.col("content")).alias("kind"))
    entries = written(read_archives(named.where("kind = 'zip'").select("path", "content")), "entries")
    picked = choose_entry(entries, chosen)
    rejected = entries.groupBy("path").agg(F.min("reject_reason").alias("rejected"))
    inside = entries.select("path", "entry", "content").join(picked.select("path", "entry"), ["path", "entry"])
    alone = named.where("kind = 'html'").select("path", F.lit(None).cast("string").alias("entry"), "content")
    pages = written(alone.unionByName(inside).select("path", "entry", F.sha2("content", 256).alias("content_hash")), "imported")
    first = pages.groupBy("content_hash").agg(F.min("path").alias("first"))
    known = stored.select("content_hash", F.col("document_id").alias("known"))
    # Few paths share their bytes with the first; it is joined by path, so that copies of one page don't meet in a task.
    firsts = first.select(F.col("first").alias("path"), F.lit(True).alias("is_first"))
    found = pages.join(known, "content_hash", "left").join(firsts, "path", "left")
    found = found.select(
        "path", F.coalesce("known", F.concat(F.lit("doc-"), F.substring("content_hash", 1, 20))).alias("document_id"), (F.col("known").isNotNull() | F.col("is_first").isNull()).alias("duplicate")
    )
    error = F.when(F.col("kind").isNull(), "no page or archive, or too large").otherwise(F.coalesce("rejected", "error"))
    out = named.select("path", "kind").join(picked, "path", "left").join(rejected, "path", "left").join(found, "path", "left")
    none = F.array().cast("array<string>")
    return out.select("path", "kind", "entry", F.coalesce("choices", none).alias("choices"), error.alias("error"), "document_id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))
