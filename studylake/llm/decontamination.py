"""Benchmark decontamination in DataFrame operations alone: SimHash of item-sized windows, multi-index Hamming, exact check.

An item and a window are compared by their word shingles, ``shingle`` words each (all words where there are fewer), each
weighing as often as it occurs: similarity is the sum of the smaller weights over the sum of the larger. The sum of the
larger is at least an item's n shingles, so at similarity ``s`` or more a window holds at least ``s n`` shingles that occur in
the item, wherever they stand and whether or not the text's start or end cuts the window. Windows are placed wherever that
is so, and nowhere else. Each window gets a SimHash; windows and items whose fingerprints differ in at most
``max_distance`` bits meet through one of several blocks in which they differ in at most one bit. A window meets the item
that it was placed for in any case, so the radius loses none. What meets is compared exactly.

Texts are split into words twice, and shuffled once to their windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, only, words_of

BITS = 64
#: Items up to this number of different shingles are sent to all tasks; beyond, Spark joins by a shuffle as sizes tell.
BROADCAST_KEYS = 50_000
#: Words of a text whose windows are cut at a time.
STRETCH = 1 << 14


def _shingles(words: Column, shingle: int) -> Column:
    """Hashes of the shingles, made different by counting the repeats of each: a set whose overlap is that of weights."""
    n = F.size(words)
    last = F.greatest(n - shingle + 1, F.lit(1))
    hashes = F.array_sort(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(shingle)), " "))))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _runs(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, by position."""
    last = F.size(words) - length + 1
    at = lambda i: F.xxhash64(*(F.get(words, i + F.lit(k)) for k in range(length)))
    return F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), at))


def _numbered(hashes: Column) -> Column:
    return F.transform(hashes, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(hashes, h)))


def _simhash(hashes: Column) -> Column:
    """Bit b is set if it is set in over half the hashes; a long of 64 bits."""
    half = F.size(hashes) / 2
    ones = lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(ones(b) > half, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def _blocks(blocks: int) -> list[tuple[int, int]]:
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _block_values(fp: Column, blocks: int, flips: bool) -> Column:
    """(block, value) of a fingerprint, with all values that differ in one bit if ``flips``."""
    out = []
    for b, (start, width) in enumerate(_blocks(blocks)):
        value = F.expr(f"shiftrightunsigned(fp, {start}) & {(1 << width) - 1}")
        for mask in [0] + [1 << i for i in range(width)] * flips:
            out.append(F.struct(F.lit(b).alias("block"), value.bitwiseXOR(F.lit(mask).cast("bigint")).alias("value")))
    return F.explode(F.array(*out))


def _row_key() -> list[Column]:
    return [F.col("id"), F.xxhash64("text").alias("h1"), F.length("text").alias("h2")]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.h1") == F.col(f"{b}.h1")) & (F.col(f"{a}.h2") == F.col(f"{b}.h2"))


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    shingle: int = 5,
    similarity: float = 0.8,
    max_distance: int = 17,
    blocks: int = 9,
) -> DataFrame:
    """Items found in texts: ``(id, item, start, n_words, similarity, h1, h2)``, one row for each text and item;
    ``h1`` and ``h2``, hash and length of the text, tell rows of one id apart.

    ``start`` and ``n_words`` give the best window in words, the first of several. Words are lower-cased and split at
    ASCII white space. Items and texts that are null or blank match nothing. Rows of ``docs`` that agree in id and text
    give their matches once; a null id is an id. Of items that share an id each text counts. Empty tables give no rows.
    """
    if max_distance >= 2 * blocks:
        raise ValueError("fingerprints within the radius must share a block but for one bit: take more blocks")
    scratch = Scratch(docs.sparkSession, "decontamination")
    base = only(items, item=item_col, text=item_text_col).withColumn("words", words_of(F.col("text"))).where(F.size("words") > 0)
    base = base.withColumn("hashes", _shingles(F.col("words"), shingle)).withColumn("fp", _simhash(F.col("hashes")))
    base = base.select(
        "item", "words", "fp", F.size("words").alias("w"), _numbered(F.col("hashes")).alias("shingles"),
        F.greatest(F.ceil(F.size("hashes") * F.lit(similarity) - F.lit(1e-9)), F.lit(1)).cast("int").alias("need"),
    ).distinct()
    base = scratch.write(base.withColumn("row", F.monotonically_increasing_id()))
    source = only(docs, id=id_col, text=text_col).where(F.length("text") > 0)
    split = source.select(*_row_key(), words_of(F.col("text")).alias("words"))
    # An item of fewer words than a shingle is one run of its own length.
    lengths = sorted(r[0] for r in base.select(F.least("w", F.lit(shingle))).distinct().collect()) or [shingle]
    key_columns = ["row", "w", "need", "key"]
    keys = [scratch.write(base.where(F.least("w", F.lit(shingle)) == n).select("row", "w", "need", F.explode(F.array_distinct(_runs(F.col("words"), n))).alias("key")).select(key_columns)) for n in lengths]
    small = sum(k.count() for k in keys) <= BROADCAST_KEYS
    send = F.broadcast if small else (lambda df: df)
    hits = []
    for n, k in zip(lengths, keys):
        met = split.select("id", "h1", "h2", F.posexplode(_runs(F.col("words"), n)).alias("at", "key")).join(send(k), "key")
        # Windows from ``at + n - w`` to ``at`` hold the hit: one more from the first, one less after the last.
        steps = F.array(F.struct((F.col("at") + n - F.col("w")).alias("p"), F.lit(1).alias("d")), F.struct((F.col("at") + 1).alias("p"), F.lit(-1).alias("d")))
        hits.append(met.select("id", "h1", "h2", "row", "w", "need", F.explode(steps).alias("s")))
    steps = reduce(DataFrame.unionByName, hits).groupBy("id", "h1", "h2", "row", "w", "need", F.col("s.p").alias("p")).agg(F.sum("s.d").alias("d"))
    along = Window.partitionBy("id", "h1", "h2", "row", "w", "need").orderBy("p")
    held = steps.withColumn("n", F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("p").over(along)).where("n >= need")
    placed = held.select("id", "h1", "h2", "row", "w", F.explode(F.sequence(F.col("p"), F.col("next") - 1)).alias("start"))
    windows = scratch.write(placed.select("id", "h1", "h2", "row", "w", "start").distinct())
    # A text meets its windows a stretch at a time, so what a row holds is bounded for texts of any length.
    stretch = F.floor(F.col("start") / STRETCH)
    per_text = windows.groupBy("id", "h1", "h2", stretch.alias("stretch")).agg(F.collect_list(F.struct("start", "w", "row")).alias("places"))
    texts = source.select(*_row_key(), "text")
    held = texts.alias("t").join(scratch.write(per_text).hint("merge").alias("p"), _same("t", "p")).select("t.id", "t.h1", "t.h2", words_of(F.col("t.text")).alias("words"), "places")
    each = held.select("id", "h1", "h2", "words", F.explode("places").alias("p")).where(F.col("p.start") < F.size("words"))
    first = F.greatest(F.col("p.start"), F.lit(0))
    cut = F.slice("words", first + 1, F.col("p.w") + F.least(F.col("p.start"), F.lit(0)))
    placed = each.select("id", "h1", "h2", first.alias("start"), cut.alias("cut"), F.col("p.row").alias("row"))
    printed = placed.withColumn("hashes", _shingles(F.col("cut"), shingle)).select(
        "id", "h1", "h2", "row", "start", F.size("cut").alias("n_words"), _simhash(F.col("hashes")).alias("fp"), _numbered(F.col("hashes")).alias("shingles")
    )
    printed = scratch.write(printed.distinct())
    ask = printed.select("id", "h1", "h2", "start", "n_words", F.col("fp").alias("fp1"), F.col("shingles").alias("s1"), _block_values(F.col("fp"), blocks, False).alias("b")).select(
        "*", "b.block", "b.value"
    )
    index = base.select("item", F.col("fp").alias("fp2"), F.col("shingles").alias("s2"), _block_values(F.col("fp"), blocks, True).alias("b")).select("item", "fp2", "s2", "b.block", "b.value")
    near = (F.col("a.block") == F.col("i.block")) & (F.col("a.value") == F.col("i.value")) & (F.bit_count(F.col("fp1").bitwiseXOR(F.col("fp2"))) <= max_distance)
    pair = ["id", "h1", "h2", "start", "n_words", "item", "s1", "s2"]
    met = ask.alias("a").join(send(index).alias("i"), near).select(pair)
    own = printed.withColumnsRenamed({"fp": "fp1", "shingles": "s1"}).join(send(base.select("row", "item", F.col("fp").alias("fp2"), F.col("shingles").alias("s2"))), "row")
    met = met.unionByName(own.where(F.bit_count(F.col("fp1").bitwiseXOR(F.col("fp2"))) > max_distance).select(pair))
    shared = F.size(F.array_intersect("s1", "s2"))
    checked = met.select("id", "h1", "h2", "start", "n_words", "item", (shared / (F.size("s1") + F.size("s2") - shared)).alias("similarity"))
    best = checked.where(F.col("similarity") >= similarity).groupBy("id", "h1", "h2", "item").agg(
        F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"), F.col("n_words"))).alias("b")
    )
    return best.select("id", "item", (-F.col("b.s")).alias("start"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"), "h1", "h2")


def drop_contaminated(docs: DataFrame, matches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without a match in ``find_items``' result; all columns stay, whatever their names."""
    own, h1, h2 = (fresh(docs, n) for n in ("found_id", "found_h1", "found_h2"))
    found = matches.select(F.col("id").alias(own), F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct()
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(h1)) & (F.length(text) == F.col(h2))
    return docs.join(found, same, "left_anti")
