"""Assets and archives: paths, styles, media types by magic bytes, embedded images, video addresses, safe ZIP reading."""

from __future__ import annotations

import base64
import binascii
import io
import re
import stat
import zipfile
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Media types by extension, limits of archives and images.
MIME = {"css": "text/css", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf"}
EXTENSIONS = frozenset(MIME) | {"html", "htm"}
MAX_HTML, MAX_ZIP, MAX_EXPANDED, MAX_ENTRIES, MAX_RATIO = 10 << 20, 100 << 20, 250 << 20, 1000, 200
MAX_IMAGE_CHARS, MAX_IMAGE_BYTES = 12 << 20, 8 << 20
RASTER = ("image/png", "image/jpeg", "image/gif", "image/webp")
VIDEO_HOSTS = frozenset(("youtube.com", "www.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com"))
VIDEO_PARAMETERS = ("start", "autoplay", "controls", "rel", "loop", "mute", "cc_lang_pref", "cc_load_policy", "hl")
REMOTE = r"(?i)^(?:https?:|data:|javascript:|vbscript:|file:|//)"


def normal_path(base: str, value: str) -> str | None:
    """A path relative to ``base`` without dots, or None if it is remote, absolute, or leaves the root (HTM-6)."""
    clean = re.split(r"[?#]", value, maxsplit=1)[0].replace("\\", "/")
    if not clean or re.match(REMOTE, clean) or clean.startswith("/"):
        return None
    kept: list[str] = []
    for part in f"{base}/{clean}".split("/"):
        if part == ".." and not kept:
            return None
        if part == "..":
            kept.pop()
        elif part not in ("", "."):
            kept.append(part)
    return "/".join(kept)


def normal_path_column(base: Column, value: Column) -> Column:
    """``normal_path`` as an expression: a fold over the parts, with a stack that is null once it was left."""
    clean = F.replace(F.regexp_replace(value, r"(?s)[?#].*$", ""), F.lit("\\"), F.lit("/"))
    bad = (clean == "") | F.rlike(clean, F.lit(REMOTE)) | F.startswith(clean, F.lit("/"))
    parts = F.filter(F.split(F.concat(base, F.lit("/"), clean), "/"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(p)))
    return F.when(~bad, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def _css_end(css: str, at: int, stop: str) -> int:
    """Place after the next ``stop`` outside of quotes, or the end."""
    quote = ""
    while at < len(css):
        c = css[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == stop:
            return at + 1
        at += 1
    return at


def safe_css(css: str, rewrite) -> str:
    """Styles without imports and expressions, addresses rewritten by ``rewrite`` (HTM-7): one scan over names before a bracket."""
    out, at, lower = [], 0, css.lower()
    while at < len(css):
        if lower.startswith("@import", at):
            at = _css_end(css, at, ";")
        elif lower.startswith("url(", at):
            end = _css_end(css, at + 4, ")")
            address = css[at + 4 : end].removesuffix(")").strip()
            if len(address) > 1 and address[0] == address[-1] and address[0] in "\"'":
                address = address[1:-1]
            out.append(f'url("{rewrite(address) or ""}")')
            at = end
        elif lower.startswith("expression", at) and lower[at + 10 :].lstrip().startswith("("):
            at = _css_end(css, at + 10, ")")
        else:
            out.append(css[at])
            at += 1
    return "".join(out)


def image_type(data: bytes) -> str | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "image/png"
    if data[:2] == b"\xff\xd8":
        return "image/jpeg"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "image/gif"
    return "image/webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def safe_data_uri(value: str) -> str | None:
    """A canonical data URI of a raster image, or None (SRC-8)."""
    head, comma, rest = value.partition(",")
    scheme, _, kind = head.lower().partition(":")
    mime, _, coding = kind.partition(";")
    payload = "".join(rest.split())
    if (scheme, coding) != ("data", "base64") or mime not in RASTER or not comma or not payload:
        return None
    bare = payload.rstrip("=")
    if len(payload) > MAX_IMAGE_CHARS or len(bare) % 4 == 1:
        return None
    try:
        data = base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None
    canonical = base64.b64encode(data).decode().rstrip("=") == bare
    return f"data:{mime};base64,{payload}" if data and len(data) <= MAX_IMAGE_BYTES and canonical and image_type(data) == mime else None


@F.pandas_udf(StringType())
def safe_data_uri_column(values: pd.Series) -> pd.Series:
    """``safe_data_uri`` of a column."""
    return values.map(safe_data_uri, na_action="ignore")


def embed_url(value: str) -> str | None:
    """The private address of an embedded video, with the parameters that are known, or None (HTM-8)."""
    try:
        url = urlsplit(value)
    except ValueError:
        return None
    if url.scheme != "https" or url.hostname not in VIDEO_HOSTS or not re.fullmatch(r"/embed/[A-Za-z0-9_-]{6,}", url.path):
        return None
    given = dict(reversed(parse_qsl(url.query, keep_blank_values=True)))
    query = urlencode([(k, given[k]) for k in VIDEO_PARAMETERS if k in given])
    return f"https://www.youtube-nocookie.com{url.path}" + (f"?{query}" if query else "")


def embed_url_column(value: Column) -> Column:
    """``embed_url`` as an expression."""
    host, path = F.lower(F.try_parse_url(value, F.lit("HOST"))), F.try_parse_url(value, F.lit("PATH"))
    ok = F.startswith(value, F.lit("https://")) & host.isin(*VIDEO_HOSTS) & F.rlike(path, F.lit(r"^/embed/[A-Za-z0-9_-]{6,}$"))
    parameter = lambda k: F.try_parse_url(value, F.lit("QUERY"), F.lit(k))
    pairs = F.array_compact(F.array(*(F.when(parameter(k).isNotNull(), F.concat(F.lit(f"{k}="), parameter(k))) for k in VIDEO_PARAMETERS)))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.lit("https://www.youtube-nocookie.com"), path, query))


def mime_type(path: Column) -> Column:
    """Media type by extension (SRC-7)."""
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def valid_asset(extension: Column, content: Column) -> Column:
    """Whether the first bytes are those of the extension's type (SRC-6)."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda *prefixes: F.rlike(head, F.lit("^(?:" + "|".join(prefixes) + ")"))
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return (
        F.when(extension == "css", ~F.contains(F.hex(F.regexp_replace(F.substring(text, 1, 512), "[^\\x00]", "")), F.lit("00")))
        .when(extension == "png", starts("89504E470D0A1A0A"))
        .when(extension.isin("jpg", "jpeg"), starts("FFD8"))
        .when(extension == "gif", starts("474946383761", "474946383961"))
        .when(extension == "webp", starts("52494646.{8}57454250"))
        .when(extension == "svg", F.rlike(text, F.lit(r"(?i)<svg[\s>]")))
        .when(extension == "woff", starts("774F4646"))
        .when(extension == "woff2", starts("774F4632"))
        .when(extension == "ttf", starts("00010000", "74727565"))
        .when(extension == "otf", starts("4F54544F"))
        .otherwise(False)
    )


def import_kind(name: Column, content: Column) -> Column:
    """``html`` or ``zip`` for what can be imported, null for what is too large or another type (SRC-3)."""
    size = F.octet_length(content)
    html = F.rlike(name, F.lit(r"(?i)\.html?$")) & (size <= MAX_HTML)
    archive = F.rlike(name, F.lit(r"(?i)\.zip$")) & (F.hex(F.substring(content, 1, 2)) == "504B") & (size <= MAX_ZIP)
    return F.when(html, "html").when(archive, "zip")


def _reject(info: zipfile.ZipInfo) -> str | None:
    name = info.filename.replace("\\", "/")
    if name.startswith("/") or re.match(r"^[A-Za-z]:", name) or ".." in name.split("/"):
        return "unsafe path"
    if stat.S_ISLNK(info.external_attr >> 16):
        return "symbolic link"
    if name.rpartition(".")[2].lower() not in EXTENSIONS:
        return "extension"
    if info.file_size > MAX_RATIO * max(1, info.compress_size):
        return "compression ratio"
    return None


ENTRIES = "path string, entry string, uncompressed bigint, compressed bigint, content binary, reject_reason string"


def read_archives(files: DataFrame) -> DataFrame:
    """Entries of ZIP files ``(path, content)``, as ``binaryFile`` gives them (SRC-4).

    A breach of one entry or of the archive's limits rejects the archive: its rows have the reason and no content. A task
    holds one archive and gives its entries in bounded batches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "entry", "uncompressed", "compressed", "content", "reject_reason"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                    infos = [i for i in archive.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(path, None, None, None, None, "not an archive")], columns=columns)
                    continue
                reasons = [_reject(i) for i in infos]
                whole = next((r for r in reasons if r), None)
                if len(infos) > MAX_ENTRIES:
                    whole = "too many entries"
                elif sum(i.file_size for i in infos) > MAX_EXPANDED:
                    whole = "too large"
                for info, reason in zip(infos, reasons):
                    data = None
                    if not whole:
                        with archive.open(info) as f:
                            data = f.read(info.file_size + 1)
                        if len(data) > info.file_size:
                            whole, data = "larger than declared", None
                    yield pd.DataFrame([(path, info.filename, info.file_size, info.compress_size, data, reason or whole)], columns=columns)

    return files.select("path", "content").mapInPandas(run, ENTRIES)


def choose_entry(entries: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``(path, entry, choices, error)``: the page of each archive (SRC-5): the only one, or the one named, else choices."""
    pages = entries.where("reject_reason is null").where(F.rlike("entry", F.lit(r"(?i)\.html?$")))
    listed = pages.groupBy("path").agg(F.array_sort(F.collect_list("entry")).alias("choices"))
    listed = entries.select("path").distinct().join(listed, "path", "left").withColumn("choices", F.coalesce("choices", F.array().cast("array<string>")))
    named = listed.withColumn("wanted", F.lit(None).cast("string")) if chosen is None else listed.join(chosen.select("path", F.col("entry").alias("wanted")), "path", "left")
    entry = F.when(F.col("wanted").isNotNull(), F.when(F.array_contains("choices", F.col("wanted")), F.col("wanted"))).when(F.size("choices") == 1, F.col("choices")[0])
    error = F.when(F.size("choices") == 0, "no page").when(F.col("wanted").isNotNull() & ~F.array_contains("choices", F.col("wanted")), "no such entry")
    return named.select("path", entry.alias("entry"), "choices", error.alias("error"))
