import zlib

import numpy as np
import pytest

from studylake.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [Q.features("".join(rng.choice(list("ab CD.\n9"), int(n)))) for n in rng.integers(0, 4000, 6)]
    y = np.array([0, 1, 0, 1, 1, 0.0])
    model = Q.fit(bags, y, epochs=1)
    x, starts = np.concatenate(bags).astype(float), np.cumsum([0, *(len(b) for b in bags[:-1])])
    cost = np.ones(6) / 6
    loss = lambda: -(cost * (y * np.log(s := model.scores(x, starts)) + (1 - y) * np.log(1 - s))).sum()
    grads = model.gradients(model.forward(x, starts), starts, y, cost)
    for name in ("w", "v", "u", "a", "c"):
        value = getattr(model, name)
        at = tuple(int(i) for i in rng.integers(0, value.shape))
        kept = value[at]
        value[at] = kept + 1e-5
        up = loss()
        value[at] = kept - 1e-5
        down = loss()
        value[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = Q.held_out("doc_id")
    model = Q.train(docs, labels.where(~out))
    rows = Q.score(docs, model).join(labels.where(out), labels.doc_id == Q.F.col("id")).collect()
    assert all(zlib.crc32(str(r.id).encode()) % 3 == 1 for r in rows)
    assert len(rows) > 80 and np.mean([(r.score >= 0.5) == r.quality for r in rows]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "one short line", "c"), (3, "wort " * 60_000, "d")], "doc_id long, text string, score string"
    )
    labels = spark.createDataFrame([(2, 0), (2, 1), (None, 1), (9, 0), (3, 7)], "doc_id long, quality int")
    rows = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), none).count() == 0
    assert len(Q.features("é" * 5000)) == -(-10_000 // Q.PASSAGE) and not Q.features(None).any()


def test_scores_match_a_plain_computation(spark):
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = Q.train(docs, labels)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    got = {r.id: r.score for r in Q.score(docs, m).collect()}
    for r in docs.collect():
        hidden, logits = [], []
        for x in Q.features(r.text):
            size = float(x[Q.SIZE]) * Q.PASSAGE
            x = [(float(a) - b) / c * size / (size + Q.SHRINK) for a, b, c in zip(x, m.mean, m.scale)]
            h = [math.tanh(sum(a * w for a, w in zip(x, m.w[:, j])) + m.b[j]) for j in range(Q.HIDDEN)]
            gate = [math.tanh(sum(a * v for a, v in zip(h, m.v[:, j]))) * sigmoid(sum(a * u for a, u in zip(h, m.u[:, j]))) for j in range(Q.GATE)]
            hidden.append(h)
            logits.append(sum(g * a for g, a in zip(gate, m.a)))
        e = [math.exp(v - max(logits)) for v in logits]
        z = [sum(w * h[j] for w, h in zip(e, hidden)) / sum(e) for j in range(Q.HIDDEN)]
        assert got[r.doc_id] == pytest.approx(sigmoid(sum(a * c for a, c in zip(z, m.c)) + float(m.d)), abs=1e-6)


def test_repeated_labelled_ids_count_once(spark):
    docs = spark.createDataFrame([(1, "same id"), (2, "other")], "doc_id long, text string")
    many = docs.unionByName(spark.range(5000).select(Q.F.lit(1).cast("long").alias("doc_id"), Q.F.concat(Q.F.lit("text "), Q.F.col("id").cast("string")).alias("text")))
    bags, y = Q.training_sample(many, spark.createDataFrame([(1, 0), (2, 1), (1, 0)], "doc_id long, quality int"), "doc_id", "text", "quality", 10, 16)
    assert len(bags) == 2 and sorted(y) == [0, 1]


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = "".join(chr(33 + (i * i + i // 7) % 200) + " " * (i % 5 == 0) for i in range(40_000))
    whole = Q.features(text)
    monkeypatch.setattr(Q, "STRETCH", 3)
    assert len(whole) > 40 and np.array_equal(whole, Q.features(text))
