"""Text functions with the semantics of web text: Unicode white space, ASCII case, code units, word sets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as browsers define it; Java's default class knows ASCII alone.
SPACE = r"[\s\x0B   -     　﻿]"
#: Runs of it other than one plain space, which stays as it is; most characters are ruled out by the first range.
RUN = f"[^!-~](?:(?<= ){SPACE}|(?<! )(?<={SPACE})){SPACE}*"
RESERVED = r'[<>:"/\\|?*]'


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends (TXT-1)."""
    return F.trim(F.regexp_replace(text, RUN, " "))


def or_else(*values: Column) -> Column:
    """First value that is neither null nor an empty string (PRJ-4)."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values[:-1]), values[-1])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is: the case rule of keys and LIKE (SRT-2)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def code_units(text: Column) -> Column:
    """Length in UTF-16 code units; astral characters count two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def token_estimate(text: Column) -> Column:
    """A token for every four characters, rounded up (HTM-10)."""
    return F.ceil(F.length(text) / 4).cast("long")


def words(text: Column) -> Column:
    """Words between white space, without empty ones (TXT-5)."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    """Different lower-cased runs of ASCII word characters (TXT-8)."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))


def similarity(a: Column, b: Column) -> Column:
    """Shared words over the larger word set; 1 for equal texts, 0 if one is empty (ANC-2)."""
    x, y = word_set(a), word_set(b)
    shared = F.size(F.array_intersect(x, y)).cast("double") / F.greatest(F.size(x), F.size(y), F.lit(1))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(shared)


def slice_text(text: Column, start: Column | int, stop: Column | int) -> Column:
    """Characters from ``start`` up to ``stop``, counted from 0 (TXT-3)."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return F.substr(text, (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))


def index_of(text: Column, part: Column) -> Column:
    """Place of the first occurrence, from 0, or -1 (TXT-4)."""
    return F.instr(text, part).cast("long") - 1


def escape_html(text: Column) -> Column:
    """The four characters that matter in HTML text and attributes; the ampersand first (EX-6)."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def group_name(name: Column) -> Column:
    """A group's name with white space collapsed; null if it has not 1 to 80 characters (HTM-13)."""
    clean = collapse(name)
    return F.when(F.length(clean).between(1, 80), clean)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def file_stem(title: Column, fallback: Column | str = "Untitled", *, normalize: bool = True) -> Column:
    """A title as the stem of a file's name: compatibility forms, no control or reserved characters, 120 characters (HTM-14).

    ``normalize=False`` leaves out the compatibility forms, the only step that needs Python, for titles known to be plain.
    """
    clean = nfkc(title) if normalize else title
    clean = F.regexp_replace(clean, r"[\x00-\x1F\x7F]", " ")
    clean = collapse(F.regexp_replace(clean, RESERVED, ""))
    clean = F.regexp_replace(clean, r"^[. ]+|[. ]+$", "")
    clean = F.regexp_replace(F.substring(clean, 1, 120), r"[. ]+$", "")
    return or_else(clean, F.lit(fallback) if isinstance(fallback, str) else fallback)
