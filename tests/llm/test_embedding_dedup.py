import numpy as np
import pytest

from studylake.llm import embedding_dedup as E


def brute(rows, cosine=0.9):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    x = np.array([np.array([*v, *[0.0] * (16 - len(v))]) if g else np.zeros(16) for (_, v), g in zip(rows, ok)])
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.maximum(np.outer(norm, norm), 1e-300) >= cosine
    near &= np.outer(ok, ok)
    np.fill_diagonal(near, False)
    label = np.arange(n)
    while True:
        then = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(n)])
        if (then == label).all():
            break
        label = then
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        c = min(ids) if ids and ok[i] else d
        out.append((d, int(near[i].sum()), c, d is not None and d == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("limit", "sample"), [(4096, 20_000), (40, 40)])
def test_matches_brute_force(spark, limit, sample):
    rng = np.random.default_rng(limit)
    f32 = lambda v: [float(np.float32(c)) for c in v]
    rows = [(i, f32(rng.normal(size=16))) for i in range(300)]
    center = rng.normal(size=16)
    rows += [(1000 + i, f32(center + 0.2 * rng.normal(size=16))) for i in range(200)]  # dense: all within the spill
    rows += [(2000 + i, rows[i % 7][1]) for i in range(60)] + [(3000, f32(np.array(rows[3][1]) * 2))]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [1.0, None]), (4005, [float("inf")] * 16)]
    rows += [(None, rows[0][1]), (None, [9.0] * 3), (4006, [9.0] * 3), (4006, [9.0] * 3), (4007, [0.0, 1.0]), (4008, [-0.0, 1.0])]
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<float>, leaf int")
    got = E.embedding_links(df, leaf_size=64, leaf_limit=limit, sample=sample, trees=12, spill=0.15)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_only_bad_vectors_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in E.embedding_links(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert E.embedding_links(df.limit(0)).count() == 0


def test_recall_on_borderline_pairs():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * noise
    forest = E.Forest(np.concatenate([x, y]), 50_000, 10, 1024, 0.035, 11)
    a, b = (set(zip(*map(np.ndarray.tolist, forest.leaves(z)))) for z in (x, y))
    assert len({row for row, _ in a & b}) / len(x) > 0.99
    forest = E.Forest(np.concatenate([x, y]), 50_000, E.trees_for(50_000, 128), 128, 0.02, 11)
    a, b = (set(zip(*map(np.ndarray.tolist, forest.leaves(z)))) for z in (x, y))
    assert len({row for row, _ in a & b}) / len(x) > 0.99
    assert E.trees_for(500, 128) == 8 < E.trees_for(50_000, 128) < E.trees_for(10**9, 128) < 100


def test_large_leaves_are_split_on_and_keep_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * noise
    cuts = np.array(E.split_leaf(77, 40_000, x[: E.LEAF_SAMPLE], 128, 0.035))
    leaf = np.full(len(x), 77)
    a, b = (E.descend_leaf(z, leaf, np.tile(cuts, (len(z), 1)), 0.035) for z in (x, y))
    sizes = np.unique(a[1], return_counts=True)[1]
    assert len(sizes) == 2**E.DEPTH and sizes.max() < len(x) / 5
    pairs = [set(zip(*map(np.ndarray.tolist, z))) for z in (a, b)]
    assert len({r for r, _ in pairs[0] & pairs[1]}) > 0.85 * len(x)  # one tree's five levels; ten trees miss almost none
    assert np.isnan(E.split_leaf(1, 10_000, np.tile(x[:1], (512, 1)), 128, 0.035)[0])


def test_links_survive_leaves_that_are_split_on(spark):
    """Borderline pairs and a dense cluster, end to end, with trees that are grown on a sample of 300 and refined.

    Of the links in the cluster, half of which have a cosine below 0.92, 85010 of 85116 are found.
    """
    rng = np.random.default_rng(21)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1500, 64)))
    noise = rng.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(1, keepdims=True) * x)
    close = unit(unit(rng.normal(size=(1, 64))) + 0.3 * unit(rng.normal(size=(300, 64))))
    v = np.concatenate([x, 0.905 * x + np.sqrt(1 - 0.905**2) * noise, close])
    near = v @ v.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {r[0]: r[1] for r in E.embedding_links(df, sample=300, leaf_size=64, leaf_limit=128).collect()}
    want = near.sum(1)
    assert all(got[i] <= want[i] for i in range(len(v)))
    assert sum(got.values()) >= 0.99 * want.sum()
    assert sum(got[i] for i in range(3000)) >= 0.99 * want[:3000].sum()
    assert sum(got[i] for i in range(3000, 3300)) >= 0.995 * want[3000:].sum()  # upper levels may part its border pairs


def test_more_vectors_bring_few_more_entries():
    rng = np.random.default_rng(5)
    mean = []
    for n in (5_000, 50_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows, leaves = E.Forest(x[:20_000], n, E.trees_for(n, 256, 2), 256, 0.02, 11, 2, 0.0446).leaves(x)
        mean.append(len(rows) / n)
        assert (np.unique(leaves, return_counts=True)[1].astype(float) ** 2).sum() < 0.6 * n**2
    assert mean[1] < 2 * mean[0] < 30
