import re

import numpy as np
import pytest

from studylake.llm import simhash


def jaccard(a, b, k=5):
    s = [set(simhash.shingle_hashes(t, k).tolist()) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


def test_one_of_each_group_stays(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [[word() for _ in range(int(rng.integers(60, 300)))] for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        for j in range(3):
            edited = list(w)
            edited[int(rng.integers(0, len(w)))] = word()
            rows.append((100 + 10 * i + j, " ".join(edited)))
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " "), (3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, "alone and null"), (None, "alone and null")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, sha string, __id string, text_sha_0 string")
    for block in (2048, 1):
        got = simhash.drop_near_duplicates(docs, block_texts=block).collect()
        assert all(tuple(r)[2:] == ("x", "y", "z") for r in got)
        kept = [(r.doc_id, r.text) for r in got]
        assert len(kept) == len(set(kept)) and all(k in rows for k in kept)
        assert {d for d, _ in kept} == {*range(25), 2000, None}
        for _, text in rows:
            assert max(jaccard(text, t) for _, t in kept) >= 0.8
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_each_stage_acts_on_small_data(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        then = spark.read.parquet(str(tmp_path / str(i)))
        if i < len(pipeline.STAGES) - 1:
            assert then.columns == columns, name
        counts.append(then.count())
        docs = then
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5] > 100
    rows = docs.collect()
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)
    originals = {m for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for m in re.findall(r"\S+@\S+\.com", r.text)}
    assert originals and not any(o in r.text for o in originals for r in rows)


def test_stages_take_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 50_000, None, "s", None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd, sf).count() >= 0
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_cut_and_extended_copies_meet(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for i in range(150):
        w = [word() for _ in range(int(rng.integers(100, 400)))]
        n = len(w) - int(0.19 * (len(w) - 4))
        block = [word() for _ in range(int(0.1 * len(w)))]
        copy = [w[:n], w[len(w) - n :], w + [word() for _ in range(int(0.23 * (len(w) - 4)))], w[: len(w) // 2] + block + w[len(w) // 2 :]][i % 4]
        rows += [(i, " ".join(w)), (1000 + i, " ".join(copy))]
    texts = dict(rows)
    assert all(0.8 <= jaccard(texts[i], texts[1000 + i]) < 0.91 for i in range(150))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == list(range(150))


def test_large_components_are_settled_exactly(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base = [word() for _ in range(200)]
    rows = []
    for _ in range(400):
        w = list(base)
        for at in rng.choice(200, 4, replace=False):
            w[int(at)] = word()
        rows.append((len(rows), " ".join(w)))
    for i in rng.choice(400, 20, replace=False):
        w = rows[int(i)][1].split()
        w[int(rng.integers(0, 200))] = word()
        rows.append((len(rows), " ".join(w)))
    sets, stay = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows], []
    for i, s in enumerate(sets):
        if not any(len(s & sets[j]) >= 0.8 * len(s | sets[j]) for j in stay):
            stay.append(i)
    assert 300 < len(stay) < 420
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 120):
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, block_texts=block).collect()) == stay


def test_chains_leave_no_text_without_a_kept_neighbour(spark):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for _ in range(40):  # each text is near the one before it, and the ends of a chain are not near each other
        w = [word() for _ in range(100)]
        for _ in range(15):
            rows.append((int(rng.integers(0, 1 << 40)), " ".join(w)))
            w = list(w)
            for at in rng.choice(100, 2, replace=False):
                w[int(at)] = word()
    sets, stay = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in rows}, []
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for d in sorted(sets):
        if not any(near(d, k) for k in stay):
            stay.append(d)
    docs = spark.createDataFrame(rows + [(-1 - i, rows[7][1]) for i in range(600)], "doc_id long, text string")
    want = {-600 if d == rows[7][0] else d for d in stay}
    for block in (2048, 6):
        kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, block_texts=block).collect()}
        sets[-600] = sets[rows[7][0]]
        assert all(any(near(d, k) for k in kept) for d in sets)
        assert not any(near(a, b) for a in kept for b in kept if a < b)
        assert len(kept) <= 1.1 * len(want)
