import re

import pytest

from studylake.llm import pii as P

ENTITIES = {
    "email": ["ann.lee7@mail.example.com", "Ann.Lee7@mail.example.com", "x@y.org", "die.55@mail4.example.com"],
    "card": ["4785380592391139", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"],
    "ssn": ["123-45-6789"],
    "ip": ["152.143.123.131", "10.0.0.1"],
    "phone": ["+1 (017) 555-7713", "+10175557713", "030 1234 5678", "+33 1 23 45 67 89", "+33123456789", "01 23 45 67 89", "030 1234567", "+49 30 1234567"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "name": ["Mr Smith", "Mr. Smith", "Mrs Jane Doe", "Frau Müller", "Господин Иванов", "Dr O’Neil"],
}
CLEAN = ["1.2 and 3.4.5", "see page 12345", "a@b", "version 10.20.30.400", "in 2024-01-02 at 10:20", "Mr is a title", "+1 is a vote", "no signs", "0.12 34 56 78 90", "from 01 02 03 to 05", "0 12345", "2024-05 123456", "+5 10 20", "pages 555-1234"]


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def run(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, pii_found_0 string")
    return {r.doc_id: r for r in P.replace_pii(docs, key=kw.pop("key", "k"), count_col="n", **kw).collect()}


def test_types_formats_and_coreference(spark):
    flat = [(k, e) for k, es in ENTITIES.items() for e in es]
    texts = [f"é word {e}, and {e} then" for _, e in flat]
    got = run(spark, texts)
    out = {}
    for i, (kind, e) in enumerate(flat):
        first, second = re.fullmatch(r"é word (.*), and (.*) then", got[i].text).groups()
        assert first == second != e and got[i].n == 2
        if kind == "phone" and e in ("+10175557713", "+33123456789"):
            assert re.fullmatch(r"\+(?:1|33)[0-9]{9,10}", first) and len(first) == len(e)
        elif kind in ("card", "ssn", "phone"):
            assert re.sub(r"\d", "0", first) == re.sub(r"\d", "0", e)
        out[e] = first
    assert all((luhn(e) % 10 == 0) == (luhn(out[e]) % 10 == 0) for e in ENTITIES["card"])
    assert out["4111 1111 1111 1111"].replace(" ", "") == out["4111111111111111"]
    assert out["ann.lee7@mail.example.com"] == out["Ann.Lee7@mail.example.com"]
    assert re.sub(r"\D", "", out["+1 (017) 555-7713"]) == re.sub(r"\D", "", out["+10175557713"])
    assert re.sub(r"\D", "", out["+33 1 23 45 67 89"]) == out["+33123456789"][1:] and out["+49 30 1234567"].startswith("+49 ")
    assert out["01 23 45 67 89"].startswith("0") and out["030 1234567"].startswith("0")
    assert re.fullmatch(r"Mrs [A-Z][a-z]+a [A-Z][a-z]+", out["Mrs Jane Doe"]) and re.fullmatch(r"Mr [A-Z][a-z]+n", out["Mr Smith"])
    assert out["Mr. Smith"].replace(".", "") == out["Mr Smith"]
    assert re.fullmatch(r"Господин [А-Я][а-я]+н", out["Господин Иванов"])
    moved = lambda s: int("".join(str(int(c, 36)) for c in s.replace(" ", "")[4:] + s[:4]))
    assert all(moved(out[e]) % 97 == 1 and out[e][:2] == e[:2] for e in ENTITIES["iban"])
    assert run(spark, texts, key="other")[0].text != got[0].text


def test_odd_rows_stay(spark):
    texts = [None, "", *CLEAN, "x " * 50_000 + "call +1 (017) 555-7713" + " y" * 50_000]
    got = run(spark, texts)
    assert [got[i].text for i in range(len(texts) - 1)] == texts[:-1]
    assert got[len(texts) - 1].n == 1 and len(got[len(texts) - 1].text) == len(texts[-1])
    assert all(r.pii_found_0 == "f" for r in got.values())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.replace_pii(empty, key="k").count() == 0


@pytest.mark.parametrize("literals", [500, 0])
def test_collisions_are_resolved(spark, monkeypatch, literals):
    # All entities of a type draw the same sequence, so all but one collide at each attempt.
    monkeypatch.setattr(P, "_digest", lambda key, kind, normal, attempt, part: P.F.sha2(P.F.concat_ws(":", attempt.cast("string"), P.F.lit(part)), 256))
    texts = [f"{e} twice {e}" for e in ("111-22-3333", "222-33-4444", "333-44-5555", "444-55-6666")] + ["none", None, "111-22-3333 twice 111-22-3333"]
    got = run(spark, texts, max_literals=literals)
    made = [got[i].text.split(" twice ") for i in range(4)]
    assert all(a == b for a, b in made) and len({a for a, _ in made}) == 4
    assert got[6].text == got[0].text and got[4].text == "none" and got[5].text is None


def test_parts_of_names_are_shared_and_later_mentions_follow(spark):
    got = run(spark, ["Mr Smith met Mr John Smith. Later Smith and Smithson left, and SMITH too.", "Mrs Smith, and Smith.", "Smith alone", "Dr SMITH"])
    one, given, two, later, rest = re.fullmatch(r"Mr (\w+) met Mr (\w+) (\w+)\. Later (\w+) and Smithson left, and (\w+) too\.", got[0].text).groups()
    assert one == two == later and given not in ("John", one) and rest == "SMITH" and got[0].n == 2
    woman, again = re.fullmatch(r"Mrs (\w+), and (\w+)\.", got[1].text).groups()
    assert woman == again and woman[:-1] == one[:-1] and woman != one
    assert got[2].text == "Smith alone" and got[3].text == "Dr " + (one[:-1] + "s").upper()


def test_crowded_formats_get_longer_surrogates(spark, monkeypatch):
    # Digests of all entities alike, and attempts that repeat: a format without room.
    monkeypatch.setattr(P, "CROWDED", 2)
    monkeypatch.setattr(P, "_digest", lambda key, kind, normal, attempt, part: P.F.sha2(P.F.lit(part), 256))
    texts = [f"{n}11-22-3333 " for n in range(1, 7)] + [f"Mr {n}" for n in ("Able", "Baker", "Charlie")]
    got = run(spark, texts)
    made = [got[i].text for i in range(len(texts))]
    assert len(set(made)) == len(texts) and not set(made) & set(texts)


def test_replacement_matches_a_row_by_row_one(spark):
    """Texts are rebuilt from their pieces: what stands between entities stays, and one mapping of entities explains all."""
    import regex

    pattern = regex.compile(P.ANY.replace("\\p{IsCyrillic}", "\\p{Cyrillic}"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.doc_id: r.text or "" for r in P.replace_pii(docs, key="k").collect()}
    mapping, n = {}, 0
    for d, text in before.items():
        at, out = 0, after[d]
        rest = regex.compile("(.*?)".join(regex.escape(p) for p in _pieces(pattern, text)), regex.DOTALL).fullmatch(out)
        assert rest, d
        for m, new in zip(pattern.finditer(text), rest.groups()):
            n += 1
            form = regex.sub(r"[ ().-]", "", m[0].lower()) if not "@" in m[0] else m[0].lower()
            assert mapping.setdefault(form, new) == new or regex.sub(r"\D", "", mapping[form]) == regex.sub(r"\D", "", new)
            assert new != m[0]
    assert n > 5 and len(set(mapping.values())) == len(mapping) and not set(mapping.values()) & set(mapping)


def _pieces(pattern, text):
    at, out = 0, []
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]
