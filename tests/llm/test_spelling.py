import random
import re
import zlib
from collections import Counter

import pytest

from studylake.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every=31):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if abs(len(x) - len(y)) != 1:
        return False
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def grouped(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items())


def rows_of(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def made_words(seed, n=900):
    """Words that share beginnings, ends and runs of one letter, with their edits; counts that make chains of forms."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(["aa", "ab", "ba", "é", "ÿx"]) for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["a" * k for k in range(6, 15)]
    words = {}
    for _ in range(n):
        w = rng.choice(stems)
        for _ in range(rng.randint(0, 2)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + rng.choice("ab÷z") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("aby") + w[i + 1 :]])
        words[w] = rng.choice([2, 3, 25, 40, 400, 4100])
    return words


@pytest.mark.parametrize("limit, few", [(20_000, 6), (40, 6), (3, 0), (1, 6)])
def test_equals_comparing_all_words(spark, monkeypatch, limit, few):
    words = {w: n for w, n in made_words(limit).items() if len(w) >= 7}
    monkeypatch.setattr(spelling, "FEW", few)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variant_groups(df, group_limit=limit)) == grouped(words)


def test_owners_look_up_what_comparison_finds():
    words = [w for w in made_words(5) if len(w) >= 2]
    for size in {len(w) for w in words}:
        many = spelling.Owners()
        for w in words:
            if len(w) == size:
                many.add(w, w, 1)
        for v in words:
            if abs(size - len(v)) <= 1 and len(many.words) > spelling.FEW:
                assert sorted(w for w, _ in many.near(v, size - len(v))) == sorted(w for w, _, _ in many.words if one_edit(w, v))


def test_words_lose_letters_by_their_checksum(spark):
    text = "Reading readings ÀÉreading RÉADINGÀ x9alphabetic alphabetic-alphabetic it's 17thcentury " + "z" * 5000
    rows = [(i, text) for i in range(200)] + [(None, text), (None, None), (3, ""), (3, text)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.word_counts(df).collect()}
    assert got == counted(rows)
    assert {r.word: r.n for r in spelling.word_counts(df, typo_every=None).collect()} == counted(rows, None)


def test_short_words_and_empty_tables(spark):
    df = spark.createDataFrame([("abcdef", 50), ("abcdeg", 2), ("abcdefg", 2)], "word string, n long")
    assert rows_of(spelling.variant_groups(df)) == [("abcdef", 50, 0, None, None, "abcdef"), ("abcdefg", 2, 0, None, None, "abcdefg"), ("abcdeg", 2, 0, None, None, "abcdeg")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(spelling.word_counts(empty)).collect() == []
