import numpy as np
import pytest
import sentencepiece

from studylake.llm import sentencepiece as S


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(open(S.MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    """The library's own Unigram over the same pieces: the model's file with its type set from BPE to Unigram."""
    data = open(S.MODEL, "rb").read()
    out = bytearray()
    for number, value in S._fields(data):
        if number == 2:
            fixed = value.replace(b"\x18\x02", b"\x18\x01", 1)
            assert fixed != value
            value = fixed
        size, n = bytearray(), len(value)
        while n > 127:
            size.append(n & 127 | 128)
            n >>= 7
        out += bytes([number << 3 | 2]) + bytes(size) + bytes([n]) + value
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


TEXTS = ["Hello world", " two  spaces   three ", "Émile était là, où ça?", "a", "naïve façade 123 45.6", "line\tTab", "x" * 40, "", "und die Straße", "New York (NY)!"]
ODD = [None, "▁ literal", "😀 \U0001f9d1‍\U0001f4bb", "\x00\x01 \n\n", "汉字 混合 ﷽", " ", "   ", "z" * 5000 + "é" * 300 + "▁" * 70, "word " * 20_000]


def test_same_pieces_as_the_library(pieces, library):
    texts = [t for t in TEXTS if "\t" not in t]
    assert [x.tolist() for x in pieces.encode(texts, {})] == [library.encode(t) for t in texts]


def test_long_units_and_batches_agree(pieces):
    rng = np.random.default_rng(5)
    units = [" " + "".join(rng.choice(list("abcdeé tion😀"), int(n))).replace(" ", "") for n in rng.integers(1, 60, 300)]
    assert pieces.solve(units) == [pieces._ids(u, *pieces._path(u)) for u in units]


def test_round_trip(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS + ODD)] + [(3, "again", "c"), (3, "again", "c"), (None, "no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    got = S.decode(S.encode(docs)).collect()
    assert sorted(((r.id, r.text) for r in got), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    both = S.encode(docs, decoded=True).collect()
    assert sorted(((r.id, r.text) for r in both), key=repr) == sorted(((r.id, r.text) for r in got), key=repr)
    by = {r.id: r for r in S.encode(docs).collect()}
    assert by[len(TEXTS) + 1].n_fallback == 3 and len(by[len(TEXTS)].piece_ids) == 0
    assert S.encode(docs.limit(0)).count() == 0


def test_small_cache(pieces, monkeypatch):
    monkeypatch.setattr(S, "CACHE", 2)
    texts = TEXTS * 2
    cache = {}
    assert [pieces.decode(i) for i in pieces.encode(texts, cache)] == texts
    assert [pieces.decode(i) for i in pieces.encode(texts[:1], cache)] == texts[:1]


def test_units_hold_one_group_and_lose_no_piece(pieces):
    rng = np.random.default_rng(7)
    alphabet = list("aAbeéßtion  .,!\n\t$019▁😀汉取获жшї­\x00«")
    texts = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(1, 200, 300)] + [t for t in TEXTS + ODD[1:-2] if t]
    whole = [np.frombuffer(pieces._ids(" " + t, *pieces._path(" " + t)), dtype="<i4") for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(pieces.encode(texts, {}), whole, strict=True))
    assert pieces.units.findall(" the.\nThe,  2024!!") == [" the", ".", "\n", "The", ",", "  2024", "!!"]


def test_a_word_is_solved_once_whatever_signs_follow(pieces, monkeypatch):
    asked, solve = [], pieces.solve
    monkeypatch.setattr(pieces, "solve", lambda units: asked.extend(units) or solve(units))
    cache = {}
    pieces.encode([f"wordy{s} wordy{s}\n" for s in ".,;:!?)"], cache)
    assert asked.count(" wordy") == 1 and sorted(asked) == sorted([" wordy", "\n", *".,;:!?)"])
    pieces.encode(["wordy!; " + "x" * 33], cache)
    assert set(asked[9:]) == {"!;", " " + "x" * 33}
    assert "!;" in cache and max(map(len, cache)) <= S.CACHED


def test_units_at_hand_are_not_solved_again_when_the_cache_is_full(pieces, monkeypatch):
    monkeypatch.setattr(S, "CACHE", 4)
    asked, solve = [], pieces.solve
    monkeypatch.setattr(pieces, "solve", lambda units: asked.extend(units) or solve(units))
    cache = {}
    pieces.encode(["one two three"], cache)
    got = pieces.encode(["one two three four five"], cache)
    assert pieces.decode(got[0]) == "one two three four five" and sorted(asked) == sorted([" one", " two", " three", " four", " five"])
    assert len(cache) <= 4


def test_solved_together_as_alone(pieces):
    units = ["😀", " 汉字\n", "", " ", "   ", "▁", " a▁é😀", "«»", " tion", "x" * S.BATCHED, "\x00" * S.BATCHED, "y" * (S.BATCHED + 1)]
    assert pieces.solve(units) == [pieces._ids(u, *pieces._path(u)) for u in units]
    assert pieces.solve([]) == [] and pieces.solve([""]) == [b""]


def test_ids_decode_in_parts(pieces, monkeypatch):
    monkeypatch.setattr(S, "DECODED", 3)
    texts = [t or "" for t in TEXTS + ODD[:-2]]
    assert [pieces.decode(i) for i in pieces.encode(texts, {})] == texts


def test_pieces_over_groups_join_them():
    assert S._units(["▁ab", "b.", "..", "12"]).findall(" ab.a 12c") == [" ab.a", " 12c"]
    signs, letters = [a + b for a, b in zip("!\"#$%&'()*+,-./:", "\"#$%&'()*+,-./:;")], [a + b for a, b in zip("abcdefghijklmnop", "bcdefghijklmnopq")]
    assert S._units(signs + letters).findall(" ab]-^ab..1") == [" ab", "]", "-", "^", "ab", "..", "1"]
    assert S._units(signs + letters + ["o.k"]).findall(" ab]-^ab..1") == [" ab", "]", "-", "^", "ab..", "1"]
