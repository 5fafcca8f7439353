"""Main texts of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks: stretches of text between the edges of block elements. Features of a block are
the tags, classes, ids and roles of its ancestors and the shape of its text (length, share of links, ending, place), never its
words. Weights come from labelled pages by maximum likelihood (forward and backward sums over whole pages), and the best
labelling of a page is found by the Viterbi algorithm; its article blocks are the text.

Labelled pages are those of the given table whose markup says what the article is (an ``article`` or ``main`` element), a bounded
sample (``SAMPLE_PAGES``), and the same articles set into other layouts (``page_layouts``), so that the model doesn't lean on
that markup alone. Pages are independent: they are parsed, scored and decoded where they lie, without a shuffle.

Defined results: null and empty pages, and pages without an article, have the empty text; rows that repeat are each returned;
an empty table gives an empty result (training needs no rows either: without any, layouts hold made-up words); whole pages of
any length are parsed in time linear in their length; further columns, of any name, are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, tidy
from .page_layouts import MARK, Layout

#: Pages that training reads at most, characters that such a page has at most, layouts that each article is set in, and
#: characters of an article used in them.
SAMPLE_PAGES, SAMPLE_CHARS, LAYOUTS, ARTICLE_CHARS = 400, 200_000, 5, 4000
SEED = 13

#: Fixed values of HTML: elements that start a block, that have no end tag, and whose content is not page text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html ins label legend li main "
    "menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title noscript svg math iframe object noembed noframes xmp canvas audio video".split())
#: What an element's start ends if it is still open on top: items of lists, cells, options, and paragraphs.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "optgroup": ("option", "optgroup")}
#: Open elements beyond this depth add no features.
DEPTH = 200

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]{0,65536}"|'[^']{0,65536}')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]+|[A-Z]{2,}")
_HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class Block:
    text: str
    linked: int
    path: frozenset[str]
    own: str
    parent: str
    marked: bool


@dataclass
class _Open:
    name: str
    path: frozenset[str]
    marked: bool


def _own_features(name: str, attributes: str) -> set[str]:
    found = {f"t:{name}"}
    if attributes:
        for _, a, b, c in _NAMED.findall(attributes):
            found.update(f"c:{part.lower()}" for part in _PART.findall(a or b or c)[:12])
        if _HIDDEN.search(attributes):
            found.add("hidden")
    return found


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order, with white space collapsed and character references decoded."""
    out: list[Block] = []
    stack = [_Open("", frozenset(), False)]
    counts: dict[str, int] = {}
    pieces: list[str] = []
    linked, in_link = 0, False
    known: dict[tuple[str, str, frozenset], frozenset] = {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                out.append(Block(text, linked, top.path, top.name, stack[-2].name if len(stack) > 1 else "", top.marked))
            pieces.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    def pop() -> None:
        counts[stack.pop().name] -= 1

    at, last = 0, html.rfind(">")
    while True:
        match = _TAG.search(html, at) if at <= last else None
        if match is None:
            # After the last ">" a tag that begins is never closed, and is no text.
            rest = html[at:]
            begun = re.search(r"<[/!?a-zA-Z]", rest)
            say(rest[: begun.start()] if begun else rest)
            break
        if match.start() > at:
            say(html[at : match.start()])
        at = match.end()
        closing, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                in_link = False
            elif name in BLOCK and name not in VOID:
                flush()
                in_link = False
                if counts.get(name):
                    while stack[-1].name != name:
                        pop()
                    pop()
            elif name == "br":
                pieces.append(" ")
            continue
        if name in RAW:
            if not attributes.endswith("/") or name not in ("svg", "math"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            pieces.append(" ")
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCK:
            flush()
            if stack[-1].name == "p":
                pop()
            for _ in range(3):
                if stack[-1].name in ENDS.get(name, ()):
                    pop()
            if name in VOID:
                continue
            top = stack[-1]
            path = top.path
            if len(stack) < DEPTH:
                key = (name, attributes, path)
                path = known.get(key)
                if path is None:
                    path = known[key] = top.path | _own_features(name, attributes)
            stack.append(_Open(name, path, top.marked or MARK in attributes))
            counts[name] = counts.get(name, 0) + 1
    flush()
    return out


#: Elements that are part of no article, wherever they stand: the weak labels of pages that mark their article.
APART = frozenset("t:nav t:aside t:footer t:form t:button t:select t:option t:label hidden".split())


def marked_article(found: list[Block]) -> list[bool] | None:
    """Labels of blocks where the page's markup gives them, else None."""
    for tag in ("t:article", "t:main"):
        labels = [tag in b.path and not b.path & APART for b in found]
        if any(labels):
            return labels
    return None


def _shape(block: Block, place: int, many: int) -> Iterator[str]:
    text = block.text
    words = text.count(" ") + 1
    length = min(words.bit_length(), 8)
    share = block.linked / max(1, len(text))
    link = 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3
    yield f"own:{block.own}"
    yield f"parent:{block.parent}"
    yield f"words:{length}"
    yield f"link:{link}"
    yield f"link:{link} words:{length}"
    yield f"own:{block.own} words:{length}"
    yield f"end:{text[-1] in '.!?…:;' and 1 or 0} words:{length}"
    if "©" in text[:40] or "|" in text or "·" in text:
        yield "signs"
    yield f"place:{min(place, 3)}"
    yield f"left:{min(many - 1 - place, 3)}"


def features(found: list[Block]) -> Iterator[list[str]]:
    """Features of each block."""
    for i, block in enumerate(found):
        yield [*block.path, *_shape(block, i, len(found))]


@dataclass
class Model:
    """Weights of a block's features for its being part of the article, and of labels that follow each other."""

    weights: dict[str, float] = field(default_factory=dict)
    start: tuple[float, float] = (0.0, 0.0)
    follow: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))


def viterbi(scores: list[float], model: Model) -> list[bool]:
    """The best labels of blocks by their scores for label 1; ties go to 0."""
    if not scores:
        return []
    (w00, w01), (w10, w11) = model.follow
    a, b = model.start[0], model.start[1] + scores[0]
    back = []
    for s in scores[1:]:
        from0, from1 = b + w10 > a + w00, b + w11 > a + w01
        back.append((from0, from1))
        a, b = (b + w10 if from0 else a + w00), s + (b + w11 if from1 else a + w01)
    now = b > a
    labels = [now]
    for step in reversed(back):
        now = step[now]
        labels.append(now)
    return labels[::-1]


def article(html: str | None, model: Model, memo: dict | None = None) -> str:
    """The main text of a page: its article blocks, a line each."""
    if not html:
        return ""
    found = blocks(html)
    memo = {} if memo is None else memo
    weight = model.weights.get
    scores = []
    for i, block in enumerate(found):
        above = memo.get(block.path)
        if above is None:
            above = memo[block.path] = sum(weight(f, 0.0) for f in block.path)
        scores.append(above + sum(weight(f, 0.0) for f in _shape(block, i, len(found))))
    return "\n".join(b.text for b, keep in zip(found, viterbi(scores, model)) if keep)


def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = 200, rate: float = 0.2, decay: float = 2e-5) -> Model:
    """Weights that make the labels of pages likeliest, by gradient steps (Adam) with a small quadratic penalty."""
    pages = [p for p in pages if p[0]]
    if not pages:
        return Model()
    names: dict[str, int] = {}
    of_block, of_feature, starts, labels = [], [], [0], []
    for found, marks in pages:
        for own, mark in zip(features(found), marks):
            # A sum over a set runs in the order of names, so that equal pages give equal models.
            ids = [names.setdefault(f, len(names)) for f in sorted(own)]
            of_feature += ids
            of_block += [len(labels)] * len(ids)
            labels.append(int(mark))
        starts.append(len(labels))
    of_block, of_feature, y = np.array(of_block), np.array(of_feature), np.array(labels)
    lengths, first = np.diff(starts), np.array(starts[:-1])
    order = np.argsort(-lengths, kind="stable")
    lengths, first = lengths[order], first[order]
    alive = [int((lengths > t).sum()) for t in range(lengths[0])]
    k, n = len(names), len(y)
    weights = np.zeros(k + 6)
    m, v = np.zeros(k + 6), np.zeros(k + 6)
    seen = np.zeros(6)
    inner = np.setdiff1d(np.arange(n), first)
    np.add.at(seen, y[first], 1)
    np.add.at(seen, 2 + 2 * y[inner - 1] + y[inner], 1)
    for step in range(1, rounds + 1):
        start, follow = weights[k : k + 2], weights[k + 2 :].reshape(2, 2)
        unary = np.zeros((n, 2))
        unary[:, 1] = np.bincount(of_block, weights[of_feature], n)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[first] = start + unary[first]
        for t in range(1, len(alive)):
            at = first[: alive[t]] + t
            ahead[at] = unary[at] + np.logaddexp(ahead[at - 1, :1] + follow[0], ahead[at - 1, 1:] + follow[1])
        for t in range(len(alive) - 1, 0, -1):
            at = first[: alive[t]] + t
            reach = unary[at] + behind[at]
            behind[at - 1] = np.logaddexp(reach[:, :1] + follow[:, 0], reach[:, 1:] + follow[:, 1])
        ends = first + lengths - 1
        total = np.repeat(np.logaddexp(ahead[ends, 0], ahead[ends, 1]), lengths)
        whole = np.empty(n)
        whole[np.concatenate([np.arange(f, f + c) for f, c in zip(first, lengths)])] = total
        likely = np.exp(ahead + behind - whole[:, None])
        grad = np.zeros(k + 6)
        grad[:k] = np.bincount(of_feature, (likely[:, 1] - y)[of_block], k)
        expected = np.zeros(6)
        expected[:2] = likely[first].sum(0)
        pairs = np.exp(ahead[inner - 1][:, :, None] + follow[None] + (unary[inner] + behind[inner])[:, None, :] - whole[inner][:, None, None])
        expected[2:] = pairs.sum(0).ravel()
        grad[k:] = expected - seen
        grad = grad / len(pages) + decay * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    rest = [float(x) for x in weights[k:]]
    return Model({f: float(weights[i]) for f, i in names.items()}, (rest[0], rest[1]), ((rest[2], rest[3]), (rest[4], rest[5])))


def labelled_pages(pages: list[str], seed: int = SEED, layouts: int = LAYOUTS) -> list[tuple[list[Block], list[bool]]]:
    """Blocks and labels of pages whose markup gives their article, and of these articles in other layouts."""
    rng = random.Random(seed)
    out, articles, spare = [], [], []
    for html in pages:
        found = blocks(html)
        labels = marked_article(found)
        if labels is None:
            continue
        out.append((found, labels))
        spare += [b.text[:2000] for b in found]
        kept, room = [], ARTICLE_CHARS
        for b, mark in zip(found, labels):
            if mark and room > 0:
                kept.append((b.own, b.text[:ARTICLE_CHARS]))
                room -= len(b.text)
        if kept:
            articles.append(kept)
    if not articles:
        spare = [" ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 9))) for _ in range(60)) + "." for _ in range(200)]
        articles = [[("h1", rng.choice(spare)[:60]), *(("p", rng.choice(spare)) for _ in range(rng.randint(1, 9)))] for _ in range(100)]
    for kept in articles * layouts:
        if rng.random() < 0.5:  # paragraphs of other articles, short ones too, and other kinds of blocks
            kept = list(kept)
            for _ in range(rng.randint(1, 5)):
                kind = rng.choice(["h2", "h3", "li", "blockquote", "p", "p", "p", "pre", "td", "dd", "figcaption"])
                kept.insert(rng.randint(1, len(kept)), (kind, rng.choice(spare)[: rng.choice([8, 20, 40, 200, 900])].strip() or "a"))
        if rng.random() < 0.3 and kept[0][0] == "h1":  # short titles
            kept = [("h1", " ".join(kept[0][1].split()[: rng.randint(1, 3)]) or "a"), *kept[1:]]
        found = blocks(Layout(spare, rng).page(kept))
        out.append((found, [b.marked for b in found]))
    return out


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """The model of at most ``sample`` pages of ``SAMPLE_CHARS`` at most: those whose ids hash lowest, so that the choice is the
    same in every run. The hashes are chosen first, so that no task sends more pages to the driver than are used."""
    rows = only(pages, id=id_col, html=html_col).withColumn("html", F.col("html").cast("string"))
    rows = rows.where(F.length("html") <= SAMPLE_CHARS).withColumn("h", F.xxhash64("id"))
    lowest = [r.h for r in rows.select("h").orderBy("h").limit(sample).collect()]
    if not lowest:
        return fit(labelled_pages([]))
    chosen = rows.where(F.col("h") <= lowest[-1]).orderBy("h", "id", F.md5("html")).limit(sample)
    return fit(labelled_pages([r.html for r in chosen.select("html").collect()]))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, text, *carry)`` of every page: its main text."""
    rows = only(pages, id=id_col, html=html_col, **{f"carried_{i}": c for i, c in enumerate(carry)})

    @tidy
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            memo: dict = {}
            texts = [article(html, model, memo) for html in batch.column("html").to_pylist()]
            at = batch.schema.get_field_index("html")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    schema = rows.withColumn("html", F.col("html").cast("string")).withColumnRenamed("html", "text").schema
    return rows.withColumn("html", F.col("html").cast("string")).mapInArrow(run, schema).select("id", "text", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)))


#: For pages whose article is an ``article`` element of headings and paragraphs, as all of the given ones are.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(h, '<br>', ' '), '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
l AS (SELECT page_id, url, list_filter(list_transform(string_split(h, chr(1)), lambda x:
  trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS found FROM b)
SELECT page_id, url, array_to_string(found, chr(10)) AS text, CAST(length(array_to_string(found, chr(10))) AS BIGINT) AS n_chars FROM l"""
