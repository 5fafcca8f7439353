"""Labelled pages for training: articles of given pages set anew into layouts of many kinds, with the parts around them.

What belongs to the article carries ``MARK``, which is the label and never a feature. The texts of menus, notices, comments
and so on are words and sentences of the given pages, so that only structure and the shape of texts tell them apart.
"""

from __future__ import annotations

import random
from html import escape

MARK = "data-main"

#: Names of a page's parts as sites use them: elements, classes and ids of each. An empty name leaves the element bare.
ARTICLE = (
    "article", "article", "main", "div#content", "div.post", "div.entry-content", "div.article-body", "section.story", "div#main-content", "div.post-content", "div", "div#main",
    "section.content", "div.text", "td.content", "article.post", "div.article__body", "div.page-body", "div.blog-post", "div.news-text", "section", "div.hentry", "div.body-copy",
)
AROUND = ("div.container", "div#wrapper", "div.row", "div.page", "div", "div.layout", "main", "div#root", "section.wrapper", "div.site")
PARTS = ("section", "div", "div.chapter", "section.part", "div.body", "div.inner")
MENU = ("nav", "nav.main-menu", "ul.menu", "div.navbar", "div#nav", "div.navigation", "ul#topnav", "div.breadcrumbs", "nav.breadcrumb", "div.menu-bar", "div", "ul.nav", "div.tabs", "div.pagination", "nav.toc", "ul")
TOP = ("header", "div.header", "div#header", "header.site-header", "div.masthead", "div.top-bar", "div.banner", "header#top", "div.site-title")
BOTTOM = ("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal", "div#colophon", "div.bottom", "footer")
SIDE = ("aside", "aside", "aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.widget", "div.right-column", "aside.related", "div.related-posts", "section.recommended", "div.trending", "div.popular", "div.rail", "div.side")
NOTICE = ("div.cookie-notice", "div.notice", "div#cookie-banner", "div.alert", "div.gdpr-consent", "section.notification", "div.message", "div.popup", "div.modal", "div.paywall", "div.announcement", "aside.notice", "p.notice", "div.disclaimer", "div.warning", "div.consent")
ADVERT = ("div.ad", "div.advert", "div.advertisement", "div#ad-top", "div.sponsored", "aside.ads", "div.promo", "div.adsbox", "section.sponsor", "ins.adsbygoogle", "div.banner-ad", "p.ad", "div.promotion", "div.partner")
FORM = ("form", "form.newsletter", "form#search", "div.subscribe", "form.signup", "div.search-form", "form.login", "div.newsletter-signup", "form.contact", "fieldset")
COMMENTS = ("section.comments", "div#comments", "div.comment-list", "ol.commentlist", "section#discussion", "div.comments-area", "div.reader-comments", "div.responses", "section.user-comments", "div#disqus_thread", "ul.replies", "div.reactions")
COMMENT = ("div.comment", "li.comment", "div.comment-body", "article.comment", "li", "div.reply", "p", "div")
SHARE = ("div.share", "ul.social", "div.share-buttons", "div.social-links", "div.tags", "div.author-bio", "div.byline", "div.meta", "p.meta", "div.post-meta", "div.toolbar", "div.print", "footer", "footer.entry-footer")
HIDDEN = ('div style="display:none"', "div hidden", 'span aria-hidden="true"', 'div aria-hidden="true"')


def opened(name: str, more: str = "") -> tuple[str, str]:
    """Start and end tag of ``tag.class`` or ``tag#id``."""
    tag = name.split(" ")[0].split(".")[0].split("#")[0]
    rest = name[len(tag) :]
    attribute = f' class="{rest[1:]}"' if rest.startswith(".") else f' id="{rest[1:]}"' if rest.startswith("#") else rest
    return f"<{tag}{attribute}{more}>", f"</{tag}>"


class Layout:
    """One page's layout, drawn from ``rng``; ``spare`` are texts for the parts around the article."""

    def __init__(self, spare: list[str], rng: random.Random):
        self.spare, self.rng = spare or ["text"], rng

    def words(self, low: int, high: int) -> str:
        found = self.rng.choice(self.spare).split()
        at = self.rng.randrange(max(1, len(found) - high))
        return escape(" ".join(found[at : at + self.rng.randint(low, high)]))

    def within(self, names: tuple[str, ...], inner: str) -> str:
        start, end = opened(self.rng.choice(names))
        return f"{start}{inner}{end}"

    def sentences(self, low: int, high: int) -> str:
        """Paragraphs, or bare text, of as many words."""
        texts = [self.words(low, high) + self.rng.choice([".", "!", "", "?"]) for _ in range(self.rng.choice([1, 1, 1, 2, 3]))]
        return "".join(f"<p>{t}</p>" for t in texts) if len(texts) > 1 or self.rng.random() < 0.5 else texts[0]

    def menu(self) -> str:
        links = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.rng.randint(2, 8))]
        kind = self.rng.random()
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if kind < 0.6 else " | ".join(links) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in links)
        return self.within(MENU, inner)

    def top(self) -> str:
        return self.within(TOP, self.rng.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<div>{}</div>", '<a href="/">{}</a>', "<p>{}</p>"]).format(self.words(1, 8)) + (self.menu() if self.rng.random() < 0.4 else ""))

    def bottom(self) -> str:
        said = self.rng.choice(["&copy; ", "Copyright ", ""]) + self.words(1, 12) + self.rng.choice(["", " &middot; " + self.words(2, 30)])
        return self.within(BOTTOM, self.rng.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(said) + (self.menu() if self.rng.random() < 0.3 else ""))

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" if self.rng.random() < 0.6 else ""
        return self.within(SIDE, inner + (self.menu() if self.rng.random() < 0.5 else self.sentences(3, 40)))

    def form(self) -> str:
        inner = f"<label>{self.words(1, 5)}</label><input type=text><button>{self.words(1, 3)}</button>"
        return self.within(FORM, (self.sentences(3, 20) if self.rng.random() < 0.6 else "") + inner + (f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>" if self.rng.random() < 0.3 else ""))

    def comments(self) -> str:
        inner = f"<h{self.rng.choice('234')}>{self.words(1, 4)}</h{self.rng.choice('234')}>" if self.rng.random() < 0.7 else ""
        for _ in range(self.rng.randint(1, 5)):
            by = self.rng.choice(["<b>{}</b> ", "<div class=author>{}</div>", "<span>{}</span>", ""]).format(self.words(1, 3))
            inner += self.within(COMMENT, by + self.sentences(5, 80))
        return self.within(COMMENTS, inner + (self.form() if self.rng.random() < 0.3 else ""))

    def notice(self) -> str:
        return self.within(NOTICE, self.sentences(4, 50) + (f"<button>{self.words(1, 2)}</button>" if self.rng.random() < 0.4 else ""))

    def advert(self) -> str:
        return self.within(ADVERT, self.sentences(3, 30))

    def share(self) -> str:
        links = "".join(f'<a href="#">{self.words(1, 2)}</a> ' for _ in range(self.rng.randint(1, 4)))
        return self.within(SHARE, links if self.rng.random() < 0.5 else self.words(2, 12))

    def hidden(self) -> str:
        return self.within(HIDDEN, self.words(3, 30))

    def parts(self, kinds: tuple, most: int) -> list[str]:
        return [self.rng.choice(kinds)() for _ in range(self.rng.randint(0, most))]

    def page(self, article: list[tuple[str, str]]) -> str:
        """The article's blocks ``(tag, text)`` in a page."""
        marked = []
        for tag, text in article:
            kind = self.rng.choice(["p"] * 8 + ["div"]) if tag in ("p", "div", "article", "main", "section", "body") else tag
            start, end = opened(kind, f" {MARK}")
            body = escape(text)
            if kind == "p" and self.rng.random() < 0.1:
                words = body.split(" ")
                body = " ".join([*words[:1], f'<a href="/x">{" ".join(words[1:4])}</a>', *words[4:]])
            marked.append(f"<ul>{start}{body}{end}</ul>" if kind == "li" else f"{start}{body}" if kind == "p" and self.rng.random() < 0.05 else f"{start}{body}{end}")
        if marked and self.rng.random() < 0.6:
            for _ in range(self.rng.randint(1, 4)):
                marked.insert(self.rng.randint(0, len(marked)), self.rng.choice((self.advert, self.share, self.side, self.form, self.notice, self.menu, self.hidden))())
        if marked and self.rng.random() < 0.15:
            marked[0] = f"<header>{marked[0]}{self.share() if self.rng.random() < 0.5 else ''}</header>"
        if len(marked) > 2 and self.rng.random() < 0.25:
            cut = self.rng.randint(1, len(marked) - 1)
            marked = [self.within(PARTS, "".join(part)) for part in (marked[:cut], marked[cut:])]
        inside = "".join(marked)
        start, end = opened(self.rng.choice(ARTICLE))
        if self.rng.random() < 0.12:  # bare text, its lines broken by hand
            start, end = opened(self.rng.choice(("article", "article", *ARTICLE)), f" {MARK}")
            inside = "<br>".join(escape(text) for _, text in article)
        elif self.rng.random() < 0.25:
            inside += self.comments()
        if start.startswith("<td"):
            start, end = f"<table><tr><td>{self.menu()}</td>{start}", f"{end}</tr></table>"
        before = [self.top] * (self.rng.random() < 0.6) + [self.menu] * (self.rng.random() < 0.7)
        body = [f() for f in before] + self.parts((self.notice, self.advert, self.menu, self.form, self.share, self.hidden), 3)
        if self.rng.random() < 0.3:
            body = []
        rest = self.parts((self.side, self.advert, self.share, self.form, self.notice, self.menu), 3)
        if self.rng.random() < 0.4:
            rest.append(self.comments())
        self.rng.shuffle(rest)
        if body and self.rng.random() < 0.2:
            body.append(self.side())
        body += [f"{start}{inside}{end}", *rest]
        if self.rng.random() < 0.8:
            body.append(self.bottom())
        whole = "".join(body)
        for _ in range(self.rng.randint(0, 2)):
            whole = self.within(AROUND, whole)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body>{whole}</body></html>"
