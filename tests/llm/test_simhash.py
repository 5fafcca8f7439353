from itertools import combinations

import numpy as np
import pytest
import xxhash

from studylake.llm import simhash


def brute_fingerprint(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, k, distance):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, f, least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def rows_of(df):
    return sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("code", "distance", "blocks"), [("hamming", 4, 3), ("golay", 8, 3), ("hamming", 3, 4), ("full", 4, 3), ("hamming31", 4, 2), ("full", 3, 2)])
def test_anchors_cover_every_pair_within_the_distance(code, distance, blocks):
    rng = np.random.default_rng(1)
    anchors = simhash.Anchors(distance, blocks, code)
    for _ in range(200):
        x = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        y = x
        for bit in rng.choice(64, distance, replace=False):
            y ^= 1 << int(bit)
        index, cell, home = anchors.cells(np.array([x, y], dtype=np.uint64))
        assert set(cell[(index == 0) & home]) & set(cell[index == 1])


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [" ".join(f"w{rng.integers(0, 400)}" for _ in range(int(rng.integers(1, 400)))) for _ in range(40)]
    rows = []
    for i, text in enumerate(base):
        rows.append((i * 10, text))
        for j in range(int(rng.integers(0, 6))):
            words = text.split()
            words[int(rng.integers(0, len(words)))] = f"x{j}"
            rows.append((i * 10 + j + 1, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (None, base[0]), (5003, base[1]), (5003, base[1]), (5004, "ÀÉ Z z" * 3)]
    rows += [(None, "only nulls here"), (6000, "long " * 70_000)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, fp string, component string")
    for limit in (20_000, 3):
        got = simhash.simhash_components(docs, shingle=4, max_distance=4, cell_limit=limit)
        assert rows_of(got) == brute_components(rows, 4, 4)


def test_dense_cells_keep_every_link(spark):
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 2**62))
    fps = {center ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (300, 3))}
    fps = np.array(sorted(fps), dtype=np.uint64)
    home = np.ones(len(fps), dtype=bool)
    a, b = simhash.cell_links(np.zeros(len(fps), dtype=np.int64), home, fps, 4)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    seen, queue = {0}, [0]
    while queue:
        for j in np.flatnonzero(near[queue.pop()]):
            if int(j) not in seen:
                seen.add(int(j))
                queue.append(int(j))
    assert len(a) == len(seen) - 1  # a forest: as many edges as nodes reached from a root


def test_anchors_grow_with_the_fingerprints(spark):
    plans = [simhash.choose_plan(10**n, 4, 20_000) for n in (3, 6, 8, 9, 10, 11)]
    assert plans[0] == plans[2] == (3, "hamming") and plans[3] == (3, "full") and plans[4] == (2, "hamming31") and plans[5] == (2, "full")
    assert all(simhash.cell_load(10**n, 4, *p) <= 20_000 for n, p in zip((3, 6, 8, 9, 10, 11), plans))
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(0, 90)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for plan in simhash.PLANS:
        assert rows_of(simhash.simhash_components(docs, shingle=4, plan=plan)) == brute_components(rows, 4, 4), plan


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
