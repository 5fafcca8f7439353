"""HTML pages as ordered blocks: sanitising and cutting, in vectorised Python around the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.arrays import running
from .assets import embed_url, normal_path, safe_css, safe_data_uri

# Fixed values of the block model.
BLOCKS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "pre", "figcaption", "table", "img", "svg", "figure", "video"))
NESTED = frozenset(("img", "svg", "video"))
TYPES = {"img": "image", "svg": "svg", "table": "table", "figure": "diagram", "video": "video"}
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
# Elements whose contents go with them.
DROPPED = frozenset(("script", "style", "form", "object", "embed", "textarea", "xmp", "noembed", "noframes", "plaintext", "title"))
KEPT = BLOCKS | frozenset((
    "a", "abbr", "address", "article", "aside", "b", "bdi", "bdo", "body", "br", "circle", "cite", "code", "col", "colgroup", "data", "dd", "defs", "details", "dfn", "div", "dl", "dt", "ellipse", "em",
    "footer", "g", "head", "header", "hgroup", "hr", "html", "i", "iframe", "kbd", "line", "link", "main", "mark", "nav", "ol", "path", "picture", "polygon", "polyline", "q", "rb", "rect", "rp", "rt",
    "rtc", "ruby", "s", "samp", "section", "small", "source", "span", "strong", "sub", "summary", "sup", "symbol", "tbody", "td", "text", "tfoot", "th", "thead", "time", "tr", "u", "ul", "use", "var", "wbr",
))
ATTRIBUTES = {
    "*": ("id", "class", "title", "aria-label", "aria-describedby", "role"),
    "a": ("href", "name", "target", "rel"), "img": ("src", "alt", "width", "height", "srcset"), "video": ("controls", "width", "height", "aria-label"), "source": ("src", "srcset", "type", "media"),
    "iframe": ("src", "title", "width", "height", "allow", "allowfullscreen", "loading", "referrerpolicy"), "link": ("href", "rel", "media"),
    "svg": ("viewbox", "width", "height", "xmlns", "fill", "stroke", "aria-label", "role"), "path": ("d", "fill", "stroke", "stroke-width"), "g": ("transform", "fill", "stroke"),
    "circle": ("cx", "cy", "r", "fill", "stroke"), "rect": ("x", "y", "rx", "ry", "width", "height", "fill", "stroke"), "line": ("x1", "y1", "x2", "y2", "stroke"), "polyline": ("points", "fill", "stroke"),
    "polygon": ("points", "fill", "stroke"), "ellipse": ("cx", "cy", "rx", "ry", "fill", "stroke"), "text": ("x", "y", "dx", "dy", "text-anchor", "font-size", "fill"), "use": ("href",),
    "table": ("summary",), "th": ("scope", "colspan", "rowspan"), "td": ("colspan", "rowspan"),
}
ALLOWED = {k: frozenset(v) for k, v in ATTRIBUTES.items()}
#: A start of one of these ends an open paragraph, as browsers have it.
ENDS_P = BLOCKS - NESTED | frozenset(
    ("address", "article", "aside", "details", "div", "dl", "fieldset", "footer", "form", "header", "hr", "main", "nav", "ol", "section", "ul")
) - {"figcaption"}
_SPACE = re.compile(tx.SPACE + "+")


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


class Cutter(HTMLParser):
    """One pass over a page: clean HTML, blocks in the order of their start tags, and the title."""

    def __init__(self, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.css = base, [], []
        self.blocks: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.dropping: list[str] = []
        self.title: str | None = None
        self.heading: list[str] | None = None

    def _asset(self, value: str) -> str:
        path = normal_path(self.base, value)
        return f"asset:{path}" if path else ""

    def _attributes(self, tag: str, given: dict[str, str]) -> dict[str, str]:
        kept = {k: v for k, v in given.items() if k in ALLOWED["*"] or k.startswith("data-") or k in ALLOWED.get(tag, ())}
        if tag == "a":
            kept |= {"href": "#", "data-original-href": given.get("href", ""), "rel": "noopener noreferrer"}
        elif tag == "img":
            kept |= {"src": safe_data_uri(given.get("src", "")) or self._asset(given.get("src", "")), "srcset": ""}
        elif tag == "source":
            kept |= {"src": self._asset(given.get("src", "")), "srcset": ""}
        elif tag == "video":
            kept.pop("src", None)
        elif tag == "link":
            style = given.get("rel", "").lower() == "stylesheet"
            kept = {"rel": "stylesheet" if style else "", "href": self._asset(given.get("href", "")) if style else ""} | ({"media": given["media"]} if "media" in given else {})
        elif tag == "iframe":
            source = embed_url(given.get("src", ""))
            kept = {"src": source, "title": given.get("title", "video player"), "width": given.get("width", "560"), "height": given.get("height", "315"), "loading": "lazy"} if source else {}
        return kept

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k.lower(): v or "" for k, v in attrs if not k.lower().startswith("on")}
        if self.dropping:
            if tag in DROPPED and tag not in VOID:
                self.dropping.append(tag)
            return
        if tag in DROPPED:
            if tag not in VOID:
                self.dropping.append(tag)
            return
        if tag in ENDS_P:
            self._close_to("p", ("table", "td", "th", "figure"))
        if tag == "li":
            self._close_to("li", ("ul", "ol"))
        if tag not in KEPT:
            return
        block = None
        inside = any(b is not None or t in BLOCKS for t, b in self.open)
        if tag in BLOCKS and (not inside or tag in NESTED):
            block = {"tag": tag, "parts": [], "fallback": given.get("alt") or given.get("aria-label") or "", "visual": None, "from": len(self.out), "id": given.get("data-block-id")}
            self.blocks.append(block)
        kept = self._attributes(tag, given)
        if tag == "iframe" and not kept:
            tag = "span"
        if block is not None and tag == "img":
            block["visual"] = kept["src"]
        self.out.append(f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in kept.items()) + ">")
        if tag == "h1" and self.heading is None:
            self.heading = []
        if tag not in VOID:
            self.open.append((tag, block))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self._pop()

    def _pop(self) -> None:
        tag, block = self.open.pop()
        self.out.append(f"</{tag}>")
        if block is not None and block["tag"] == "svg":
            block["visual"] = "".join(self.out[block["from"] :])

    def _close_to(self, tag: str, stop: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if tag == self.dropping[-1]:
                self.dropping.pop()
            return
        if tag in VOID or not any(t == tag for t, _ in self.open):
            return
        while self.open:
            last = self.open[-1][0]
            self._pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.dropping:
            if self.dropping == ["title"]:
                self.title = (self.title or "") + data
            elif self.dropping == ["style"]:
                self.css.append(data)
            return
        for _, block in self.open:
            if block is not None:
                block["parts"].append(data)
        if self.heading is not None and any(t == "h1" for t, _ in self.open):
            self.heading.append(data)
        self.out.append(escape(data, quote=False))

    def finish(self) -> None:
        self.close()
        while self.open:
            self._pop()

    def clean(self) -> str:
        styles = "\n".join(safe_css(c, self._asset) for c in self.css)
        return (f"<style>{styles}</style>" if styles else "") + "".join(self.out)


def cut(page: str, path: str = "") -> tuple[str, str, list[tuple[str, str, str, str | None, str | None]]]:
    """Clean HTML, title, and blocks ``(tag, type, text, visual, id)`` of one page (HTM-1, HTM-2, HTM-5).

    ``id`` is what the page names a block itself, as a page that was edited does.
    """
    parser = Cutter(path.rpartition("/")[0])
    parser.feed(page or "")
    parser.finish()
    blocks = [(b["tag"], TYPES.get(b["tag"], "text"), collapse("".join(b["parts"])) or b["fallback"], b["visual"], b["id"]) for b in parser.blocks]
    stem = re.sub(r"(?i)\.html?$", "", path.rpartition("/")[2])
    title = collapse(parser.title or "") or "".join(parser.heading or []).strip() or stem or "Untitled"
    return parser.clean(), title, blocks


PARSED = "html string, title string, blocks array<struct<ordinal:bigint,tag:string,block_type:string,text:string,visual:string,own_id:string>>"


def parse_pages(pages: DataFrame, key: str, html: str, path: str | None = None) -> DataFrame:
    """``(key, html, title, blocks)`` of each page; a null page has no blocks."""
    source = pages.select(F.col(key), F.col(html).alias("__html"), (F.col(path) if path else F.lit("")).alias("__path"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [cut(h, p or "") for h, p in zip(frame["__html"], frame["__path"])]
            blocks = [[{"ordinal": i, "tag": t, "block_type": k, "text": x, "visual": v, "own_id": n} for i, (t, k, x, v, n) in enumerate(bs)] for *_, bs in made]
            yield pd.DataFrame({key: frame[key], "html": [c for c, *_ in made], "title": [t for _, t, _ in made], "blocks": blocks})

    return source.mapInPandas(run, f"{key} {source.schema[key].dataType.simpleString()}, {PARSED}")


def page_blocks(pages: DataFrame, key: str, html: str, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row a block, with running offsets and stable ids; they are array steps, so a page is not shuffled (HTM-2, HTM-3).

    ``keep_ids`` leaves blocks the ids that the page gives them, as after an edit (HTM-11).
    """
    parsed = parse_pages(pages, key, html, path)
    start = running("blocks", lambda b: (F.length(b["text"]) + 2).cast("long"), lambda _, at: at, "bigint")
    each = parsed.select(key, F.col("blocks").alias("all"), F.explode(F.arrays_zip("blocks", start.alias("starts"))).alias("z")).select(key, "all", "z.blocks.*", F.col("z.starts").alias("start"))
    before = F.size(F.filter(F.slice("all", F.lit(1), F.col("ordinal").cast("int")), lambda b: (b["tag"] == F.col("tag")) & (b["text"] == F.col("text"))))
    signature = F.concat_ws("\0", "tag", "text", before.cast("string"))
    block_id = F.concat(F.lit("block-"), F.substring(F.sha2(signature, 256), 1, 20))
    if keep_ids:
        block_id = F.coalesce(F.nullif("own_id", F.lit("")), block_id)
    return each.select(key, "ordinal", "tag", "block_type", "text", "visual", "start", (F.col("start") + F.length("text")).alias("end"), block_id.alias("block_id"))
