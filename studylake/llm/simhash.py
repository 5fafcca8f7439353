"""SimHash near-dedup by anchor-point covering.

A document's fingerprint is a 64-bit SimHash of its word shingles. Distinct fingerprints are linked when they differ in at
most ``max_distance`` bits, and links are closed to components.

Candidates come from covering codes. The 64 bits are cut into blocks so that two linked fingerprints differ in at most
``t = max_distance // blocks`` bits of some block. A linear code of covering radius R serves as the set of anchors of a
block: every block value has an anchor within R (its home), and a value within t of it has that anchor within R + t.
Each distinct fingerprint is therefore sent to every anchor within R + t in every block, and compared there with the
fingerprints whose home the anchor is. No linked pair is missed.

Which blocks and code are taken depends on the number of fingerprints (``PLANS``): the more there are, the more anchors,
so that a cell's size is bounded and the work grows with the input.

Cells of an anchor are compared within one task on eight bytes a fingerprint. A task gives a spanning forest of its
cell's links rather than the links, so what leaves it is linear in the cell. Cells above ``cell_limit`` are cut into
parts that meet pairwise, so no task holds more than two parts.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, fresh, only, shuffle_partitions, tidy, with_least
from .local_graph import roots

BITS = 64
#: Shingles hashed at a time, so that a text of any length takes bounded memory.
CHUNK = 1 << 16
#: Cells with more members than this are searched breadth first instead of pair by pair.
SMALL_CELL = 32


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash of one text: A-Z lower-cased, words split at ASCII white space, ``shingle`` words joined by a space.

    A text of fewer words is one shingle; one without words has fingerprint 0. A bit is set if it is set in over half
    the shingles' XXH64 values of seed 42. Repeated shingles count each time.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(8 * 256, dtype=np.int64)
    for at in range(0, n, CHUNK):
        some = zip(first[at : at + CHUNK], last[at : at + CHUNK])
        hashes = np.array([digest(joined[i:j], 42) for i, j in some], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((hashes + _BYTE_OFFSET).ravel(), minlength=8 * 256)
    ones = counts.reshape(8, 256) @ _BIT_OF_BYTE  # [byte, bit]
    bits = (2 * ones > n).ravel().astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


_BYTE_OFFSET = (np.arange(8) * 256).astype(np.int64)
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, fp)``, one row for each row of ``docs``; ``fp`` holds the 64 bits as a signed long."""
    source = only(docs, id=id_col, text=text_col)
    schema = f"id {source.schema['id'].dataType.simpleString()}, fp bigint"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(run, schema)


class Code:
    """A linear code given by the syndrome of each bit, with all error patterns up to a weight, by syndrome."""

    def __init__(self, checks: list[int], reach: int):
        self.checks = checks
        patterns: dict[int, list[tuple[int, int]]] = {}
        for weight in range(reach + 1):
            for at in combinations(range(len(checks)), weight):
                syndrome = 0
                for i in at:
                    syndrome ^= checks[i]
                patterns.setdefault(syndrome, []).append((weight, sum(1 << i for i in at)))
        n, width = max(patterns) + 1, max(map(len, patterns.values()))
        self.patterns, self.counts = np.zeros((n, width), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for syndrome, found in patterns.items():
            self.patterns[syndrome, : len(found)] = [p for _, p in sorted(found)]
            self.counts[syndrome] = len(found)

    def anchors(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the value, codeword within reach of it, and whether that is the nearest one, the value's home."""
        s = np.zeros(len(values), dtype=np.int64)
        for i, check in enumerate(self.checks):
            if check:
                s ^= np.where((values >> i) & 1, check, 0)
        counts = self.counts[s]
        rows = np.repeat(np.arange(len(values)), counts)
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        return rows, values[rows] ^ self.patterns[s[rows], rank], rank == 0


#: Covering codes: check bits, covering radius, and the syndrome of bit i of a block.
CODES = {
    "golay": (11, 3, lambda i: _golay_checks()[i]),
    "hamming": (4, 1, lambda i: i + 1 if i < 15 else 0),
    "hamming31": (5, 1, lambda i: i + 1 if i < 31 else 0),
    "full": (0, 0, lambda i: 0),
}
#: Blocks and code, from few copies of a fingerprint and few anchors to many.
PLANS = ((3, "hamming"), (3, "full"), (2, "hamming31"), (2, "full"))


def _widths(blocks: int) -> list[int]:
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def cell_load(count: int, max_distance: int, blocks: int, code: str) -> float:
    """Mean size of the cells of the narrowest block for ``count`` fingerprints."""
    checks, radius, _ = CODES[code]
    width = max(23, min(_widths(blocks))) if code == "golay" else min(_widths(blocks))
    reach = sum(comb(width, w) for w in range(radius + max_distance // blocks + 1))
    return count * reach / 2**checks / 2 ** (min(_widths(blocks)) - checks)


def choose_plan(count: int, max_distance: int, cell_limit: int) -> tuple[int, str]:
    """The first of ``PLANS`` whose cells hold ``cell_limit`` fingerprints at most on average, else that of the smallest."""
    fits = [p for p in PLANS if cell_load(count, max_distance, *p) <= cell_limit]
    return fits[0] if fits else min(PLANS, key=lambda p: cell_load(count, max_distance, *p))


class Anchors:
    """A covering code for each block of a fingerprint.

    ``hamming``: the perfect [15, 11] code of radius 1 on the first 15 bits of a block, the further bits as they are;
    ``hamming31``: the same with the [31, 26] code. ``full``: every value, of radius 0. ``golay``: the perfect [23, 12] code
    of radius 3 on the block, padded with zeros: fewer anchors, and fewer copies.
    """

    def __init__(self, max_distance: int, blocks: int, code: str):
        widths = _widths(blocks)
        checks, radius, syndrome = CODES[code]
        if code == "golay" and max(widths) > 23 or code.startswith("hamming") and min(widths) < 2**checks - 1:
            raise ValueError(f"no covering code {code!r} for blocks of {max(widths)} bits")
        reach = radius + max_distance // blocks
        made = {w: Code([syndrome(i) for i in range(23 if code == "golay" else w)], reach) for w in set(widths)}
        self.blocks = [(sum(widths[:i]), w, made[w]) for i, w in enumerate(widths)]
        self.copies = sum(int(c.counts.max()) for *_, c in self.blocks)

    def cells(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For uint64 fingerprints: index of the fingerprint, cell (block and anchor), and whether the cell is its home."""
        out = []
        for b, (start, width, code) in enumerate(self.blocks):
            values = ((fps >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
            rows, anchor, home = code.anchors(values)
            out.append((rows, (b << 40) | anchor, home))
        return tuple(np.concatenate(x) for x in zip(*out))


def _golay_checks() -> list[int]:
    """Syndrome of each bit of the [23, 12] Golay code: x**i modulo the generator x^11+x^9+x^7+x^6+x^5+x+1."""
    out, value = [], 1
    for _ in range(23):
        out.append(value)
        value <<= 1
        if value & (1 << 11):
            value ^= 0b101011100011
    return out


def cell_links(cell: np.ndarray, home: np.ndarray, fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within cells. Rows are sorted by cell, homes first; a pair needs at least one home."""
    if not len(cell):
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.append(starts, len(cell)))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left = np.flatnonzero(home & np.repeat(sizes <= SMALL_CELL, sizes))
    ends = np.repeat(starts + sizes, sizes)
    step = 1
    while len(left):
        left = left[left + step < ends[left]]
        near = np.bitwise_count(fps[left] ^ fps[left + step]) <= max_distance
        a.append(left[near])
        b.append(left[near] + step)
        step += 1
    for start, size in zip(starts[sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist()):
        if home[start]:
            x, y = _search(fps[start : start + size], home[start : start + size], max_distance)
            a.append(x + start)
            b.append(y + start)
    a, b = np.concatenate(a), np.concatenate(b)
    if not len(a):
        return fps[:0], fps[:0]
    nodes, inverse = np.unique(np.concatenate((fps[a], fps[b])), return_inverse=True)
    root = roots(len(nodes), inverse[: len(a)], inverse[len(a) :])
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def _search(fps: np.ndarray, home: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first search of a large cell: a member that was reached is never compared again, so a dense cell of m
    members costs about m comparisons times its diameter; only unlinked members cost m each."""
    rest = np.arange(len(fps))
    a, b, queue = [], [], []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest = int(rest[0]), rest[1:]
            if not home[at]:  # homes come first; what is left has no home among it
                break
        near = np.bitwise_count(fps[rest] ^ fps[at]) <= max_distance
        found = rest[near]
        if len(found):
            a.append(np.full(len(found), at))
            b.append(found)
            queue.extend(found.tolist())
            rest = rest[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def link_fingerprints(
    distinct: DataFrame, max_distance: int, plan: tuple[int, str] | None, cell_limit: int, scratch: Scratch
) -> DataFrame:
    """Component of each distinct fingerprint that is linked to another: ``(node, root)``, both fingerprints."""
    spark = distinct.sparkSession
    anchors = Anchors(max_distance, *(plan or choose_plan(distinct.count(), max_distance, cell_limit)))
    step = max(16, (1 << 18) // anchors.copies)
    schema = "cell bigint, away boolean, fp bigint"

    @tidy
    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), step):
                some = fps[at : at + step]
                index, cell, home = anchors.cells(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(~home), pa.array(some[index].view(np.int64))], ["cell", "away", "fp"]
                )

    copies = distinct.select("fp").mapInArrow(replicate, schema)
    large = scratch.write(copies.groupBy("cell").count().where(F.col("count") > cell_limit))
    if large.isEmpty():
        parts = copies.withColumn("part", F.lit(0))
    else:
        # A large cell is cut into k parts by fingerprint; each pair of parts meets once, in a cell of its own.
        k = F.ceil(F.col("count") / F.lit(cell_limit)).cast("int")
        mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        met = F.transform(
            F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.least(o, F.col("mine")) * F.col("k") + F.greatest(o, F.col("mine"))
        )
        parts = (
            copies.join(large.select("cell", k.alias("k")), "cell", "left")
            .withColumn("k", F.coalesce("k", F.lit(1)))
            .withColumn("mine", mine)
            .select("cell", "away", "fp", F.explode(met).alias("part"))
        )

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        rows, limit = 0, 1 << 18

        def flush(t: pa.Table) -> pa.RecordBatch:
            cell, part = t["cell"].to_numpy(), t["part"].to_numpy().astype(np.int64)
            key = np.cumsum(np.concatenate(([0], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))) if len(cell) else cell
            x, y = cell_links(key, ~t["away"].to_numpy(), t["fp"].to_numpy().view(np.uint64), max_distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows >= limit:
                whole = pa.concat_tables(kept)
                cell, part = whole["cell"].to_numpy(), whole["part"].to_numpy()
                last = np.flatnonzero((cell != cell[-1]) | (part != part[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
                if cut:
                    yield flush(whole.slice(0, cut))
                kept, rows = [whole.slice(cut)], len(whole) - cut
                limit = max(1 << 18, 2 * rows)
        if rows:
            yield flush(pa.concat_tables(kept))

    dealt = parts.repartition(shuffle_partitions(spark), "cell", "part").sortWithinPartitions("cell", "part", "away")
    edges = dealt.mapInArrow(compare, "a bigint, b bigint")
    out = connected_components(edges, "a", "b", scratch)
    scratch.drop(large)
    return out


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    max_distance: int = 4,
    plan: tuple[int, str] | None = None,
    cell_limit: int = 20_000,
) -> DataFrame:
    """Near-duplicate components of all rows: ``(id, fp, component)``.

    ``fp`` is the fingerprint as a signed long, ``component`` the smallest id that links reach. One row comes out for each
    row of ``docs``, repeated rows included. A null or blank text has fingerprint 0 and is linked like any other. A row
    whose id is null takes part in links, but is never the smallest; in a component of such rows alone, the component is
    null. An empty table gives no rows. Other columns of ``docs`` are not read. ``plan`` names blocks and code of the
    anchors; without it they follow from the number of different fingerprints.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    return _components(scratch.write(fingerprints(docs, id_col, text_col, shingle)), max_distance, plan, cell_limit, scratch)


def _components(marked: DataFrame, max_distance: int, plan: tuple[int, str] | None, cell_limit: int, scratch: Scratch) -> DataFrame:
    distinct = scratch.write(marked.groupBy("fp").agg(F.min("id").alias("least")))
    linked = link_fingerprints(distinct, max_distance, plan, cell_limit, scratch)
    rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = scratch.write(rooted)
    labels = with_least(rooted, "root", "least", "component", rooted.count(), scratch).select("fp", "component")
    return marked.join(labels, "fp").select("id", "fp", "component")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Different hashes of a text's word shingles, sorted; a text of fewer words is one shingle, one of none has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(n)], dtype=np.uint64).view(np.int64))


#: Shingles of the texts that are settled within one task; a longer text is settled alone.
BLOCK_SHINGLES = 1 << 19


class _Stays:
    """Texts that stay, by shingle: counts what a text shares with all of them at once."""

    def __init__(self, similarity: float):
        self.similarity, self.sizes, self.empty = similarity, array("i"), False
        self.places: dict[int, array] = {}

    def add(self, shingles: np.ndarray) -> None:
        self.empty |= not len(shingles)
        for h in shingles.tolist():
            self.places.setdefault(h, array("i")).append(len(self.sizes))
        self.sizes.append(len(shingles))

    def near(self, shingles: np.ndarray) -> bool:
        if not len(shingles):
            return self.empty
        found = [p for h in shingles.tolist() if (p := self.places.get(h)) is not None]
        if len(found) < self.similarity * len(shingles):
            return False
        sizes = np.frombuffer(self.sizes, dtype=np.intc)
        shared = np.bincount(np.concatenate([np.frombuffer(p, dtype=np.intc) for p in found]), minlength=len(sizes))
        return bool((shared >= self.similarity * (len(shingles) + sizes - shared)).any())


def _settle(groups: DataFrame, similarity: float) -> DataFrame:
    """Texts of groups (component, part) that go: ``(sha)``. In the order of ids, ``settled`` texts first, a text goes if it
    is near one that stays; where ``grow`` is false it is compared alone, and no later text with it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stays = None, _Stays(similarity)
        for batch in batches:
            gone = []
            component, part, settled, grow, sha = (batch.column(i).to_pylist() for i in range(5))
            for i, group in enumerate(zip(component, part)):
                if group != now:
                    now, stays = group, _Stays(similarity)
                mine = batch.column(5)[i].values.to_numpy()
                if not settled[i] and stays.near(mine):
                    gone.append(sha[i])
                elif grow[i]:
                    stays.add(mine)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], ["sha"])

    n = shuffle_partitions(groups.sparkSession)
    ordered = groups.repartition(n, "component", "part").sortWithinPartitions("component", "part", F.col("settled").desc(), F.col("least").asc_nulls_last(), "sha")
    return ordered.select("component", "part", "settled", "grow", "sha", "shingles").mapInArrow(run, "sha string")


def _dealt(groups: DataFrame, part, settled: bool, grow: bool) -> DataFrame:
    return groups.select("component", part.alias("part"), F.lit(settled).alias("settled"), F.lit(grow).alias("grow"), "least", "sha", "shingles")


def _settle_large(left: DataFrame, similarity: float, block_texts: int, scratch: Scratch) -> list[DataFrame]:
    """``_settle`` for components of any size: the first texts of each, a block that a task can hold, are settled; all others
    are compared with those that stay, in parts; so on with what is left."""
    gone = []
    while not left.isEmpty():
        order = Window.partitionBy("component").orderBy(F.col("least").asc_nulls_last(), "sha")
        first = left.select("component", "least", "sha", "n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block_texts)
        first = first.withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        first = scratch.write(first.where((F.col("total") <= BLOCK_SHINGLES) | (F.col("rank") == 1)).select("sha"))
        block = scratch.write(left.join(first, "sha", "left_semi"))
        out = scratch.write(_settle(_dealt(block, F.lit(0), False, True), similarity))
        gone.append(out)
        rest = scratch.write(left.join(first, "sha", "left_anti"))
        scratch.drop(left)
        left = rest
        if rest.isEmpty():
            break
        parts = rest.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("k")).select("component", F.greatest("k", F.lit(1)).alias("k"))
        stay = block.join(out, "sha", "left_anti").join(parts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        ask = rest.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("sha"), F.col("k")).cast("int"))
        near = scratch.write(_settle(_dealt(stay, F.col("part"), True, True).unionByName(_dealt(ask, F.col("part"), False, False)), similarity))
        gone.append(near)
        left = scratch.write(rest.join(near, "sha", "left_anti"))
        scratch.drop(rest)
        scratch.drop(block)
    return gone


#: MinHash bands for candidates: a pair of similarity s shares one with probability 1 - (1 - s**BAND_ROWS)**BANDS, which is
#: 0.9994 at 0.8 and more above, and 0.003 at 0.3, so that texts which share a passage alone make no large components.
BANDS, BAND_ROWS = 40, 8
_draw = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_MASKS, _FACTORS = _draw[0] << np.uint64(1), (_draw[1] << np.uint64(1)) | np.uint64(1)


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band of a set of shingle hashes; all sets without shingles have the same."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    values = shingles.view(np.uint64)
    for at in range(0, len(values), 256):
        least = np.minimum(least, ((values[at : at + 256, None] ^ _MASKS) * _FACTORS).min(axis=0))
    data, width = least.astype("<u8").tobytes(), 8 * BAND_ROWS
    return [xxhash.xxh64_intdigest(data[b * width : (b + 1) * width], b) for b in range(BANDS)]


def _band_links(texts: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``: each node of ``texts`` (node, text) with the smallest node of each band that it shares."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.slice(at, 1024)
                nodes, first = np.unique(some.column(0).to_numpy(), return_index=True)  # copies of a text once
                keys = np.array([band_keys(shingle_hashes(some.column(1)[int(i)].as_py(), shingle)) for i in first], dtype=np.uint64).ravel()
                nodes = np.repeat(nodes, BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes)], ["band", "node"])

    bands = scratch.write(texts.mapInArrow(run, "band bigint, node bigint").distinct())
    first = bands.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("band", "b")
    return bands.join(first, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _node(sha: str):
    """A long for a text's digest. Should two texts share one, their groups are settled as one group, with the same result."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("bigint")


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle: int = 5,
    similarity: float = 0.8,
    fingerprint_shingle: int = 2,
    max_distance: int = 4,
    block_texts: int = 2048,
) -> DataFrame:
    """Rows of ``docs`` that stay when one of each group of near duplicates does; all columns stay.

    Texts are near duplicates if their sets of ``shingle``-word shingles have that Jaccard similarity. Candidates are the
    components of two kinds of links: those of ``simhash_components`` over ``fingerprint_shingle`` words, whose fingerprints
    move less under an edit than those of long shingles, and shared MinHash bands of the ``shingle``-word shingles, as a
    pair of similarity 0.8 may lie far beyond ``max_distance`` bits: 6 pairs in 10,000 of just 0.8 have no band. Within a
    component texts go in the order of their smallest id, nulls last: a text is dropped if it is near a text that stays, and
    only then. A task settles ``block_texts`` texts and ``BLOCK_SHINGLES`` shingles of a component; of a larger one all other
    texts are compared with those of the block that stay, and the next block follows, with the same result.

    Of rows with one text the one of the smallest id stays, of equal rows one. Null, empty and blank texts are near each
    other. An empty table gives no rows. Rows meet by text and id, so no task gets all copies of a text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    key, stay_id, stay_sha = (fresh(docs, n) for n in ("text_sha", "stay_id", "stay_sha"))
    text, own = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    marked = docs.withColumn(key, F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = scratch.write(marked.groupBy(own.alias("id"), F.col(key).alias("sha")).count())
    least = scratch.write(rows.groupBy("sha").agg(F.min("id").alias("least")))
    nodes = marked.select(_node(key).alias("node"), text.alias("text"))
    prints = scratch.write(fingerprints(nodes, "node", "text", fingerprint_shingle).distinct())
    found = _components(prints, max_distance, None, 20_000, scratch)
    links = found.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
    links = links.unionByName(_band_links(nodes, shingle, scratch))
    linked = connected_components(links, "a", "b", scratch)
    # Texts that have a link, roots among them; all others stay.
    several = linked.unionByName(linked.select(F.col("root").alias("node"), "root")).distinct()
    members = scratch.write(least.withColumn("node", _node("sha")).join(several, "node").select(F.col("root").alias("component"), "sha", "least"))

    @tidy
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                made = [shingle_hashes(t.as_py(), shingle) for t in some.column(3)]
                columns = [*(some.column(i) for i in range(3)), pa.array([len(m) for m in made], pa.int64()), pa.array(made, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["component", "sha", "least", "n", "shingles"])

    # One row stands for its text: that of the smallest id, and any of several equal ones.
    stands = (F.col(key) == F.col("sha")) & F.col(stay_id).eqNullSafe(F.col("least"))
    held = marked.select(key, own.alias(stay_id), text.alias(stay_sha)).join(members.hint("merge"), stands)
    schema = f"component bigint, sha string, least {members.schema['least'].dataType.simpleString()}, n bigint, shingles array<bigint>"
    held = scratch.write(held.select("component", "sha", "least", stay_sha).mapInArrow(shingles, schema))
    twice = scratch.write(rows.where("count > 1").select(F.col("id").alias(stay_id), F.col("sha").alias(stay_sha)))
    repeats = not twice.isEmpty()
    if repeats:
        held = scratch.write(held.dropDuplicates(["sha"]))
    size = held.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("texts"))
    sizes = scratch.write(size.where((F.col("total") > BLOCK_SHINGLES) | (F.col("texts") > block_texts)).select("component", F.lit(True).alias("large")))
    held = held.join(sizes, "component", "left")
    gone = [scratch.write(_settle(_dealt(held.where("large is null"), F.lit(0), False, True), similarity))]
    if not sizes.isEmpty():
        gone += _settle_large(scratch.write(held.where("large").select("component", "least", "sha", "n", "shingles")), similarity, block_texts, scratch)
    dropped = reduce(DataFrame.unionByName, gone)
    stayers = scratch.write(least.join(dropped, "sha", "left_anti").select(F.col("least").alias(stay_id), F.col("sha").alias(stay_sha)))
    same = own.eqNullSafe(F.col(stay_id)) & (F.col(key) == F.col(stay_sha))
    stay = marked.join(stayers.hint("merge"), same, "left_semi")
    if repeats:
        stay = stay.join(twice, same, "left_anti").unionByName(stay.join(twice, same, "left_semi").dropDuplicates([id_col, key]))
    return stay.drop(key)
