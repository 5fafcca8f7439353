"""Embedding near-dedup by a forest of random-projection trees with spill.

Equal vectors form a class first, so copies cost nothing. Each tree splits the space at the median of a random projection,
again and again; near the root vectors close to a split go to both sides. Further down a tree divides without overlap, since a
spill at every level makes a tree's entries grow with its depth, where one more tree finds as many pairs for less. A linked pair
is parted in some trees, and hardly in all. Vectors are compared in double precision within the leaves of every tree.

The upper levels of the trees are fitted on a bounded sample (``sample`` classes, the first by hash); every class is sent
down all trees. A leaf that holds more than ``leaf_limit`` is split on, on a fresh sample of that leaf, round after round, so
leaves keep their size however many vectors there are, and the number of trees grows with their depth. Lower levels project on random signs drawn from the leaf's
number, so only thresholds travel. A cluster that is not divided, because it is narrower than the spill or because a split
would part over ``TOO_CLOSE`` of its linked pairs, is cut into parts of ``leaf_limit`` that meet pairwise, so a task holds two
parts at most, and no pair is left out.
A linked pair that meets in several leaves is counted in the first of them alone: a vector carries the leaves before the one
it is sent to, and they are looked at where a leaf has links. So the number of links is counted without listing pairs, and a
task gives, for each class, a count and one edge of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, only, shuffle_partitions, with_least
from .local_graph import roots


#: Share of the pairs at the threshold that a split without spill may part; a cell where it parts more is not divided.
TOO_CLOSE = 0.25


def parted(p: np.ndarray, threshold: float, reach: float) -> float:
    """Share of the pairs at the threshold of similarity that a split parts, from the projections of a sample.

    ``reach`` is how far the ends of such a pair lie from each other on a random direction, on average: a pair is parted if
    one of its ends is that near the split, and the other on its far side.
    """
    return float((np.abs(p - threshold) <= reach).mean()) / 2 if reach and len(p) >= 32 else 0.0


class Forest:
    """Projection, threshold, spill and children of every node; leaves are numbered over all trees, in the order of the trees.

    ``spill_levels`` are the levels from the root that spill, all without it. For ``reach`` see ``parted``.
    """

    def __init__(self, sample: np.ndarray, total: int, trees: int, leaf_size: int, spill: float, seed: int, spill_levels: int | None = None, reach: float = 0.0):
        rng = np.random.default_rng(seed)
        self.spill, self.spill_levels, self.reach = spill, spill_levels, reach
        self.nodes: list[tuple[np.ndarray, float, float, int, int] | None] = []
        self.roots: list[int] = []
        self.leaf: list[int] = []
        scale = max(1.0, total / max(1, len(sample)))
        for _ in range(trees):
            self.roots.append(self._grow(sample, scale, leaf_size, rng))
        # Number leaves in the order of the nodes, which is that of the trees.
        self.number = np.cumsum([n is None for n in self.nodes]) - 1

    def _grow(self, some: np.ndarray, scale: float, leaf_size: int, rng: np.random.Generator, level: int = 0) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(some) * scale <= leaf_size or len(some) < 16:
            return at
        direction = rng.normal(size=some.shape[1])
        direction /= np.linalg.norm(direction)
        p = some @ direction
        threshold = float(np.median(p))
        spill = self.spill if self.spill_levels is None or level < self.spill_levels else 0.0
        left, right = some[p <= threshold + spill], some[p >= threshold - spill]
        if max(len(left), len(right)) > 0.9 * len(some) or parted(p, threshold, self.reach) > TOO_CLOSE:
            return at  # a narrow cluster; it is compared in parts
        a = self._grow(left, scale, leaf_size, rng, level + 1)
        b = self._grow(right, scale, leaf_size, rng, level + 1)
        self.nodes[at] = (direction, threshold, spill, a, b)
        return at

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves that they reach, for unit vectors."""
        rows, leaves = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        stack = [(r, np.arange(len(x))) for r in self.roots]
        while stack:
            node, some = stack.pop()
            if not len(some):
                continue
            if self.nodes[node] is None:
                rows.append(some)
                leaves.append(np.full(len(some), self.number[node]))
                continue
            direction, threshold, spill, a, b = self.nodes[node]
            p = x[some] @ direction
            stack += [(a, some[p <= threshold + spill]), (b, some[p >= threshold - spill])]
        return np.concatenate(rows), np.concatenate(leaves)


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of unit length in double precision; shorter ones are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


#: Levels that one round adds to a leaf, and the vectors of the leaf that it is fitted on.
DEPTH, LEAF_SAMPLE = 5, 512


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 of unsigned integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signs(leaf: np.ndarray, node: np.ndarray, width: int) -> np.ndarray:
    """A unit direction for each (leaf, node): random signs."""
    seed = _mix(leaf.astype(np.uint64) * np.uint64(64) + node.astype(np.uint64))
    words = np.stack([_mix(seed + np.uint64(i)) for i in range(-(-width // 64))], axis=1)
    bits = np.unpackbits(words.view(np.uint8), axis=1)[:, :width]
    return (bits * 2.0 - 1.0) / np.sqrt(width)


def split_leaf(leaf: int, count: int, sample: np.ndarray, leaf_size: int, spill: float, reach: float = 0.0) -> list[float]:
    """Thresholds of a subtree for a leaf of ``count`` vectors, in the order of a heap; NaN where a node is not divided."""
    out = [float("nan")] * (2**DEPTH - 1)
    scale = count / max(1, len(sample))
    stack = [(0, sample)]
    while stack:
        node, some = stack.pop()
        if node >= len(out) or len(some) * scale <= leaf_size or len(some) < 16:
            continue
        p = some @ _signs(np.array([leaf]), np.array([node]), some.shape[1])[0]
        threshold = float(np.median(p))
        left, right = some[p <= threshold + spill], some[p >= threshold - spill]
        if max(len(left), len(right)) <= 0.9 * len(some) and parted(p, threshold, reach) <= TOO_CLOSE:
            out[node] = threshold
            stack += [(2 * node + 1, left), (2 * node + 2, right)]
    return out


def descend_leaf(x: np.ndarray, leaf: np.ndarray, thresholds: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the leaves below their own leaf that they reach."""
    rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    done_rows, done_nodes = [], []
    while len(rows):
        inner = node < thresholds.shape[1]
        cut = np.where(inner, thresholds[rows, np.minimum(node, thresholds.shape[1] - 1)], np.nan)
        stop = np.isnan(cut)
        done_rows.append(rows[stop])
        done_nodes.append(node[stop])
        rows, node, cut = rows[~stop], node[~stop], cut[~stop]
        p = np.einsum("ij,ij->i", x[rows], _signs(leaf[rows], node, x.shape[1]))
        left, right = p <= cut + spill, p >= cut - spill
        rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
    rows, node = np.concatenate(done_rows), np.concatenate(done_nodes)
    below = _mix(_mix(leaf[rows].astype(np.uint64)) + node.astype(np.uint64)) >> np.uint64(1)
    return rows, below.astype(np.int64)


#: Share of the pairs at the threshold that a level with the default spill parts, what it leaves of a cell's size, and the
#: share of the pairs that all trees together may part.
PARTED, KEPT, MISSED = 0.08, 0.564, 0.001


def trees_for(total: int, leaf_size: int, spill_levels: int | None = None, cosine: float = 0.9) -> int:
    """Trees that leave ``MISSED`` of the pairs at the threshold parted in all of them, eight at least.

    A hyperplane parts two vectors with a chance of their angle over pi, which holds for levels below ``spill_levels``.
    """
    if spill_levels is None:
        together = (1 - PARTED) ** max(1.0, np.log2(max(2.0, total / leaf_size)))
    else:
        below = np.ceil(max(0.0, np.log2(max(1.0, total * KEPT**spill_levels / leaf_size))))
        together = (1 - PARTED) ** spill_levels * (1 - np.arccos(cosine) / np.pi) ** below
    return max(8, int(np.ceil(np.log(MISSED) / np.log(1 - together))))


def refine(each: DataFrame, classes: DataFrame, width: int, leaf_size: int, leaf_limit: int, spill: float, scratch: Scratch, reach: float = 0.0) -> DataFrame:
    """``(class, leaf)`` with leaves over ``leaf_limit`` split on, down to ``leaf_size``, until they fit or no split divides them."""
    spark = each.sparkSession
    whole: DataFrame | None = None
    while True:
        large = each.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > leaf_limit)
        large = scratch.write(large if whole is None else large.join(whole, "leaf", "left_anti"))
        if large.isEmpty():
            return each
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("class", "leaf")))
        picked = each.join(large, "leaf").withColumn("r", rank).where(F.col("r") <= LEAF_SAMPLE).join(classes.select("class", "v"), "class")

        def fit(t: pa.Table) -> pa.Table:
            v = t["v"].combine_chunks()
            v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
            leaf, n = t["leaf"][0].as_py(), t["n"][0].as_py()
            order = np.argsort(t["class"].to_numpy())
            cuts = split_leaf(leaf, n, _unit(v, width)[order], leaf_size, spill, reach)
            return pa.table({"leaf": pa.array([leaf], pa.int64()), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

        plans = scratch.write(picked.select("leaf", "n", "class", "v").groupBy("leaf").applyInArrow(fit, "leaf bigint, cuts array<double>"))
        stuck = plans.where(F.isnan(F.col("cuts")[0])).select("leaf")
        whole = scratch.write(stuck if whole is None else whole.unionByName(stuck))
        split = plans.where(~F.isnan(F.col("cuts")[0]))

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    some = batch.slice(at, 2048)
                    cuts = some.column(2).flatten().to_numpy().reshape(len(some), -1)
                    rows, leaf = descend_leaf(_unit(some.column(3), width), some.column(1).to_numpy(), cuts, spill)
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows)), pa.array(leaf)], ["class", "leaf"])

        moved = each.join(split, "leaf").join(classes.select("class", "v"), "class").select("class", "leaf", "cuts", "v")
        below = moved.mapInArrow(descend, "class bigint, leaf bigint")
        then = scratch.write(each.join(split.select("leaf"), "leaf", "left_anti").select("class", "leaf").unionByName(below))
        scratch.drop(each)
        each = then


def leaf_links(x: np.ndarray, weight: np.ndarray, flat: np.ndarray, sizes: np.ndarray, side: np.ndarray, parts: tuple[int, int], threshold: float):
    """Links in one leaf, or between two parts of it: for each row the weight of what it is linked to, and a root.

    ``flat`` holds the rows' leaves before this one, ``sizes`` how many each has; a pair that has one in common was counted
    there. With two different parts only pairs across are met. A bit a pair is held for the rows that have links alone.
    """
    n = len(x)
    count = np.zeros(n, dtype=np.int64)
    ea, eb = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, (1 << 21) // max(1, n))
    pairs = []
    for at in range(0, n, step):
        near = x[at : at + step] @ x[at:].T >= threshold
        near &= np.arange(near.shape[1]) > np.arange(len(near))[:, None]
        if parts[0] != parts[1]:
            near &= side[at : at + step, None] != side[None, at:]
        if near.any():
            pairs.append((at, np.packbits(near, axis=1), near.shape[1]))
            # One edge to the smallest neighbour would lose links: all links of the block close to a forest instead.
            i, j = np.nonzero(near)
            nodes, inverse = np.unique(np.concatenate((i, j)), return_inverse=True)
            root = roots(len(nodes), inverse[: len(i)], inverse[len(i) :])
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            ea.append(at + nodes[moved])
            eb.append(at + nodes[root[moved]])
    root = roots(n, np.concatenate(ea), np.concatenate(eb))
    if not pairs:
        return count, root
    # Rows that share an earlier leaf, as runs of the rows that have links. Most leaves have none or two of them.
    linked = np.isin(root, root[root != np.arange(n)])
    owner = np.repeat(np.arange(n), sizes)
    flat, owner = flat[linked[owner]], owner[linked[owner]]
    order = np.lexsort((owner, flat))
    flat, owner = flat[order], owner[order]
    cuts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1], [True]))) if len(flat) else np.zeros(1, np.int64)
    runs = [owner[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
    for at, bits, width in pairs:
        near = np.unpackbits(bits, axis=1, count=width).astype(bool)
        for run in runs:
            i = run[np.searchsorted(run, at) : np.searchsorted(run, at + len(near))] - at
            if len(i):
                near[np.ix_(i, run[run >= at] - at)] = False
        count[at : at + len(near)] += near @ weight[at:]
        count[at:] += weight[at : at + len(near)] @ near
    return count, root


def embedding_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    cosine: float = 0.9,
    trees: int | None = None,
    leaf_size: int = 256,
    spill: float = 0.02,
    spill_levels: int | None = 2,
    sample: int = 20_000,
    leaf_limit: int = 2048,
    seed: int = 11,
) -> DataFrame:
    """``(id, n_links, component, kept)`` for every row of ``vectors``.

    ``n_links`` counts the other rows whose vectors have at least that cosine with the row's, ``component`` is the smallest
    id that links reach, ``kept`` whether that is the row's own. Vectors that are null, empty, zero, or hold null or
    non-finite components are linked to nothing: their component is their id. A shorter vector is compared as if filled
    with zeros. A row with a null id takes part, but its id is never the smallest; where all are null the component is
    null, and null ids are never kept. Repeated rows each come out, linked to each other. An empty table gives no rows.
    Other columns are not read. Without ``trees`` their number follows from that of the vectors. The first ``spill_levels`` levels of
    a tree spill, all with None.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    source = only(vectors, id=id_col, v=vector_col)
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    good = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & good, F.lit(False))
    # Adding zero makes the two zeros one, so that a class is a vector.
    rows = source.select("id", F.when(good, F.transform("v", lambda c: (c + F.lit(0).cast(c_type(source))).cast(c_type(source)))).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = scratch.write(classes.withColumn("class", F.monotonically_increasing_id()))
    total, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    picked = classes.orderBy(F.xxhash64("v")).select("v").limit(sample).toArrow()["v"].combine_chunks()
    picked = picked if isinstance(picked, pa.Array) else pa.concat_arrays(picked.chunks)
    reach = float(np.sqrt(2 / np.pi * max(0.0, 2 - 2 * cosine) / width))
    trees = trees or trees_for(total, leaf_size, spill_levels, cosine)
    forest = spark.sparkContext.broadcast(Forest(_unit(picked, width), total, trees, leaf_size, spill, seed, spill_levels, reach))  # bounded by the sample

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                row, leaf = f.leaves(_unit(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(leaf.astype(np.int64))], ["class", "leaf"])

    each = scratch.write(classes.select("class", "v").mapInArrow(descend, "class bigint, leaf bigint"))
    each = refine(each, classes, width, leaf_size, leaf_limit, spill if spill_levels is None else 0.0, scratch, reach)
    placed = each.groupBy("class").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))
    large = scratch.write(each.groupBy("leaf").count().where(F.col("count") > leaf_limit).select("leaf", F.ceil(F.col("count") / leaf_limit).cast("int").alias("k")))
    k = F.coalesce("k", F.lit(1))
    side = F.pmod(F.xxhash64("class"), F.col("k")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.least(o, F.col("side")) * F.col("k") + F.greatest(o, F.col("side")))
    body = classes.select("class", "v", "n").join(placed, "class")
    dealt = body.select("class", "v", "n", "leaves", F.posexplode("leaves").alias("at", "leaf")).withColumn("leaves", F.slice("leaves", F.lit(1), F.col("at")))
    dealt = dealt.join(large, "leaf", "left").withColumn("k", k).withColumn("side", side)
    dealt = dealt.select("leaf", F.explode(met).alias("cell"), "k", "side", "class", "v", "n", "leaves")
    dealt = dealt.repartition(shuffle_partitions(spark), "leaf", "cell").sortWithinPartitions("leaf", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: t[name].chunk(0) if t[name].num_chunks == 1 else pa.concat_arrays(t[name].chunks)
            leaves = column("leaves")
            flat, sizes = leaves.flatten().to_numpy(), np.diff(leaves.offsets.to_numpy())
            cls, n = column("class").to_numpy(), column("n").to_numpy()
            k = int(column("k")[0].as_py())
            count, root = leaf_links(_unit(column("v"), width), n, flat, sizes, column("side").to_numpy(), divmod(now[1], k), cosine)
            linked = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(count[linked]), pa.array(cls[root[linked]])], ["class", "links", "root"])

        for batch in batches:
            leaf, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (cell[1:] != cell[:-1])))) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                key = (int(leaf[a]), int(cell[a]))
                if key != now and held:
                    yield flush()
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    found = scratch.write(dealt.mapInArrow(compare, "class bigint, links bigint, root bigint"))
    components = connected_components(found.select("class", "root"), "class", "root", scratch)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    labelled = classes.select("class", "v", "least", "n").join(links, "class", "left").join(components.withColumnRenamed("node", "class"), "class", "left")
    labelled = labelled.select("class", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    labelled = scratch.write(labelled)
    known = with_least(labelled, "root", "least", "component", labelled.count(), scratch).select("v", "n_links", "component")
    joined = rows.where("v is not null").join(known, "v").select("id", "n_links", "component")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone).select("id", "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def c_type(source: DataFrame):
    """Type of a vector's components."""
    return source.schema["v"].dataType.elementType
