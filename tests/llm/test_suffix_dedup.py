import hashlib

import numpy as np
import pytest

from studylake.llm import suffix_dedup as S


def brute(rows, n=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - n + 1):
                first[b[i : i + n]] = min(d, first.get(b[i : i + n], d))
    out = []
    for d, b in data:
        cut = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - n + 1):
            if d is not None and first[b[i : i + n]] < d:
                cut[i : i + n] = True
        cut[-1] = False
        spans = int((cut[:-1] & ~cut[1:]).sum())
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((d, len(b), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng):
    word = lambda: "".join(rng.choice(list("abcdé"), int(rng.integers(1, 7))))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(int(rng.integers(5, 60))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [text(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(0, 8))], text(int(rng.integers(0, 20)))]
        rows.append((int(rng.integers(0, 1000)) * 2, " ".join(parts)))
    copies = [(d + 1, t) for d, t in rows[:20]] + rows[20:24] + [(None, t) for _, t in rows[30:33]]
    edits = [(d + 1, t.replace("a", "x", 1)) for d, t in rows[40:60]]
    repeats = [(3000, "Was " * 400), (3001, "Was " * 100), (3002, "q" * 49), (3003, "q" * 49), (3004, "q" * 50), (3005, "q" * 51), (3006, None), (3007, "")]
    return rows + copies + edits + repeats


@pytest.mark.parametrize("size", [8 << 20, 700])
def test_matches_brute_force(spark, size):
    rows = corpus(np.random.default_rng(size))
    docs = spark.createDataFrame([(d, t, 1, b"") for d, t in rows], "doc_id long, text string, batch int, blob binary").repartition(3)
    for n in (50, 12) if size == 700 else (50,):
        for hot in (64, 2):
            found = S.suffix_dedup(docs, length=n, batch_bytes=size, sort_at_once=2000, hot_batches=hot)
            assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, n)


def test_strings_that_all_texts_share_are_met_in_levels(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    line = " ".join(word() for _ in range(30))
    rows = [(int(i), " ".join([word(), word() * (i % 7), line, word() * (i % 5), line[: 60 + i % 20]])) for i in rng.permutation(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.suffix_dedup(docs, batch_bytes=300, hot_batches=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 60), (2, "a" + "x" * 55 + "b")], "doc_id long, text string")
    assert {r.id: bytes(r.kept) for r in S.suffix_dedup(docs, with_text=True).collect()} == {1: b"x" * 60, 2: b"ab"}
    assert S.suffix_dedup(docs.limit(0)).count() == 0


def test_groups_of_equal_strings():
    rng = np.random.default_rng(2)
    buffer = np.frombuffer(bytes(rng.choice(list(b"ab"), 4000)) + b"ab" * 300, dtype=np.uint8)
    at = np.arange(len(buffer) - 49)
    order, starts = S.equal_groups(buffer, at, 50)
    raw = buffer.tobytes()
    groups = {}
    for i in at.tolist():
        groups.setdefault(raw[i : i + 50], []).append(i)
    want = sorted(v for v in groups.values() if len(v) > 1)
    assert sorted(sorted(g.tolist()) for g in np.split(order, starts[1:])) == want


def test_runs_do_not_depend_on_the_chunk(monkeypatch):
    rows = [(t or "").encode() for _, t in corpus(np.random.default_rng(4))]
    ids, sizes = np.arange(len(rows)), np.array([len(t) for t in rows])
    made = []
    for chunk in (1 << 18, 301):
        monkeypatch.setattr(S, "CHUNK", chunk)
        b = S.Batch(b"".join(rows), ids, sizes, ids != 3, 50)
        made.append({(k, t, p) for k, t, s, e in zip(b.key.tolist(), b.text.tolist(), b.start.tolist(), b.stop.tolist()) for p in range(s, e)})
    assert made[0] == made[1] and len(made[0]) == sum(max(0, n - 49) for i, n in enumerate(sizes) if i != 3)


def test_texts_stay_where_they_are_and_popular_lines_are_not_hot(spark):
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line = text(90)
    rows = [(int(i), f"{text(500)}{line}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = S.suffix_dedup(docs, batch_bytes=1200, hot_batches=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(batch") == 1  # of the ranges alone
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)
    same = S.Batch((line * 3).encode() * 20, np.arange(20), np.full(20, 270), np.ones(20, bool), 50)
    keys, weight = S.run_weights(same)
    unlike = S.Batch("".join(f"{text(60)}{line}" for _ in range(40)).encode(), np.arange(40), np.full(40, 150), np.ones(40, bool), 50)
    assert weight.max() < 300 and S.run_weights(unlike)[1].max() > 1500 and not S.run_weights(unlike, False)[1].any()
    assert sorted(keys.tolist()) == np.unique(same.key).tolist()
