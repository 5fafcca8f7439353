import html as html_lib
import random
import re
import time
from itertools import product

import numpy as np
import pytest

from studylake.llm import html_extraction as hx
from studylake.llm.page_layouts import Layout

WORDS = "the of road and long thing said plain few other way small ring was in it green house by river".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def marked_page(rng):
    """A page with its article marked, and the article's text."""
    blocks = [prose(rng, rng.randint(2, 8))[:-1], *(prose(rng, rng.randint(4, 90)) for _ in range(rng.randint(1, 8)))]
    inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=/a>{prose(rng, 2)}</a><li><a href=/b>more</a></ul></nav><article>{inner}</article><footer>&copy; {prose(rng, 5)}</footer></body></html>"
    return page, "\n".join(blocks)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return hx.fit(hx.labelled_pages([marked_page(rng)[0] for _ in range(150)]))


def test_held_out_pages_and_layouts(model):
    rng = random.Random(2)
    for _ in range(100):
        page, text = marked_page(rng)
        assert hx.article(page, model) == text
    spare = [prose(rng, 60) for _ in range(100)]
    right = total = 0
    for _ in range(300):
        found = hx.blocks(Layout(spare, rng).page([("h1", prose(rng, 6)), *(("p", prose(rng, rng.randint(8, 80))) for _ in range(rng.randint(2, 8)))]))
        scores = [sum(model.weights.get(f, 0.0) for f in own) for own in hx.features(found)]
        right += sum(a == b.marked for a, b in zip(hx.viterbi(scores, model), found))
        total += len(found)
    assert right / total > 0.99


def test_parts_around_the_article_go(model):
    rng = random.Random(3)
    first, second, third, said = (prose(rng, 30) for _ in range(4))
    page = (
        "<body><header class='site-header'><a href=/>Site</a><nav><a href=1>Home</a></nav></header><div class='cookie-notice'>We use cookies on this site.<button>OK</button></div>"
        f"<article><h1>A title</h1><p>{first}</p><div class='ad'>{said}</div><p>{second}</p><form class='newsletter'>Subscribe now<input></form><blockquote>{third}</blockquote>"
        f"<section class='comments'><h2>2 comments</h2><div class='comment'><p>{said}</p></div></section></article><aside class='sidebar'><p>{said}</p></aside><script>var x = '<p>no</p>'</script><footer>&copy; S</footer>"
    )
    assert hx.article(page, model) == "\n".join(["A title", first, second, third])


def test_blocks_of_untidy_markup():
    texts = lambda page: [b.text for b in hx.blocks(page)]
    assert texts("a<p>b<p> c &amp; d&nbsp;\n e<br>f<li>g<li>h") == ["a", "b", "c & d e f", "g", "h"]
    assert texts("<style>p{}</style>x<script>if (a</p>b) '</div>'</script >y<!-- <p>no</p> -->z") == ["x yz"]
    assert texts("<p>1 < 2 and <b>bo</b>ld <a title='x > y' href=\"q\">link</a></p></div></p>end <unclosed") == ["1 < 2 and bold link", "end"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table><svg><title>t</title></svg><template><p>t</p></template>") == ["a", "b", "c"]
    assert texts("") == [] and texts("<") == ["<"] and texts("<script>") == [] and texts("&lt;p&gt; &#65;&#x42; &copy") == ["<p> AB ©"]
    link = hx.blocks("<nav><a href=x>all</a></nav><p>not <a>this</a></p>")
    assert [(b.linked, b.own, b.parent) for b in link] == [(3, "nav", ""), (4, "p", "")]


def test_long_and_deep_pages_take_linear_time(model):
    began = time.perf_counter()
    for page in ("<div>" * 100_000 + "x" + "</div>" * 100_000, "<a " * 300_000, "<p>word " * 50_000, '<p class="' * 50_000, "</b></i>" * 100_000, "<!--" * 100_000, "<b>" * 100_000 + "</i>" * 100_000):
        hx.article(page, model)
    assert time.perf_counter() - began < 60


def test_viterbi_equals_trying_all_labels():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7):
        for _ in range(30):
            model = hx.Model({}, tuple(rng.normal(size=2).tolist()), tuple(map(tuple, rng.normal(size=(2, 2)).tolist())))
            scores = (rng.normal(size=n) * 2).tolist()
            value = lambda ls: model.start[ls[0]] + sum(s for s, y in zip(scores, ls) if y) + sum(model.follow[a][b] for a, b in zip(ls, ls[1:]))
            assert tuple(map(int, hx.viterbi(scores, model))) == max(product((0, 1), repeat=n), key=value)
    assert hx.viterbi([], hx.Model()) == []


def test_training_learns_what_follows_what():
    """Labels that only the labels before tell: each differs from the one before it."""
    block = lambda own: hx.Block("some text", 0, frozenset([f"t:{own}"]), own, "", False)
    pages = [([block("x"), block("y"), block("z")], [False, True, False]), ([block("q"), block("y"), block("z")], [True, False, True])] * 5
    model = hx.fit(pages)
    for found, labels in pages[:2]:
        assert hx.viterbi([sum(model.weights.get(f, 0.0) for f in own) for own in hx.features(found)], model) == labels


def test_rows_without_pages(spark, model):
    rng = random.Random(4)
    page, text = marked_page(rng)
    rows = [(1, page, "t", "i"), (1, page, "t", "i"), (2, None, None, None), (3, "", "t", "i"), (None, page, "t", "i"), (4, "<nav><a href=x>only</a></nav>", "t", "i"), (5, f"<p>{html_lib.escape('a & b')}", "t", "i")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, id string")
    out = hx.extract(df, model, carry=("text",)).collect()
    got = sorted(((r[0], r[1]) for r in out), key=repr)
    assert got[:3] == [(1, text), (1, text), (2, "")] and (None, text) in got and (3, "") in got and len(got) == 7
    assert out[0].text is not None and len(out[0]) == 3


def test_training_on_tables(spark):
    rng = random.Random(5)
    made = [marked_page(rng) for _ in range(40)]
    df = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(made)], "page_id long, html string")
    model = hx.train(df.where("page_id < 30"))
    assert model == hx.train(df.where("page_id < 30").repartition(5))
    assert [r.text for r in hx.extract(df.where("page_id >= 30"), model).orderBy("id").collect()] == [t for _, t in made[30:]]
    empty = df.where("page_id < 0")
    assert hx.extract(empty, hx.train(empty)).collect() == []
    assert re.match(r"\S", hx.article(made[0][0], hx.train(empty)))
