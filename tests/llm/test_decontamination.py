from collections import Counter

import numpy as np

from studylake.llm import decontamination as D


def shingles(words, k=5):
    return Counter(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def brute(docs, items):
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for item, t in items:
            target = (t or "").lower().split()
            if not target or not words:
                continue
            b, best = shingles(target), None
            for start in range(1 - len(target), len(words)):
                a = shingles(words[max(0, start) : max(0, start + len(target))])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 and (best is None or (s, -max(0, start)) > best):
                    best = (s, -max(0, start))
            if best:
                out[d, text, item] = (round(best[0], 9), -best[1])
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 64)
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdeost"), int(rng.integers(1, 9))))
    item = lambda n: [word() for _ in range(n)]
    items = [(i, item(int(rng.integers(20, 60)))) for i in range(12)] + [(20, item(3)), (21, ["one"]), (22, item(150)), (23, (item(6) * 9)[:50])]
    docs = []
    for i, w in items:
        around = lambda: item(int(rng.integers(0, 80)))
        docs.append((len(docs), [*around(), *w, *around()]))
        docs.append((len(docs), [*around(), *[x.upper() for x in w[1:]], *around()]))
        docs.append((len(docs), [*around(), *w[: len(w) // 2], "inserted", *w[len(w) // 2 :], *around()]))
        docs.append((len(docs), [*around(), *w[: len(w) // 2], *around()]))
        docs.append((len(docs), w[2:] if len(w) > 4 else w))
    docs.append((len(docs), [x for _, w in items for x in w]))
    docs = [(d, " \n".join(w)) for d, w in docs] + [(900, None), (901, ""), (902, " "), (None, " ".join(items[0][1])), (3, "clean text"), (3, docs[0][1][0])]
    docs += [(903, "pad " * 30_000 + " ".join(items[1][1]))]
    items = [(i, " ".join(w)) for i, w in items] + [(30, None), (31, ""), (None, "a null id item of a good many words here")]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, start int, item string")
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, fp int")
    found = D.find_items(df, bench)
    got = {(r.id, r.item): (round(r.similarity, 9), r.start) for r in found.collect()}
    want = {(d, i): v for (d, _, i), v in brute(docs, items).items()}
    assert got == want and len(want) > 20
    kept = D.drop_contaminated(df.withColumn("__id", D.F.lit(1)).withColumn("found_id_0", D.F.lit(2)), found).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted((d for d, _ in docs if not any(k[0] == d for k in got) or d == 3 and (3, 0) not in got), key=repr)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.find_items(df, bench).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert D.find_items(docs, bench.limit(0)).count() == 0
    assert [(r.id, r.item, r.similarity) for r in D.find_items(docs, bench).collect()] == [(1, 1, 1.0)]


def test_moved_parts_and_cut_items_match_brute_force(spark):
    rng = np.random.default_rng(12)
    some = lambda n: ["".join(rng.choice(list("abcdeost"), int(rng.integers(3, 9)))) for _ in range(n)]
    items, docs = [], []
    for i in range(25):
        w = some(int(rng.integers(40, 90)))
        h, t, k = len(w) // 2, len(w) // 3, len(w) - int(0.16 * len(w))
        items.append((i, " ".join(w)))
        for made in ([*some(30), *w[h:], *w[:h], *some(30)], [*some(30), *w[t:], *w[:t], *some(30)], [*some(30), *w[:k]], [*w[-k:], *some(30)]):
            docs.append((len(docs), " ".join(made)))
    want = {(d, i): v for (d, _, i), v in brute(docs, items).items()}
    assert all(sum(d % 4 == kind for d, _ in want) > 10 for kind in range(4))
    found = D.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item): (round(r.similarity, 9), r.start) for r in found.collect()} == want
