"""Sharding by extendible hashing, in DataFrame operations alone.

Rows go to buckets by the leading bits of their key's hash. A directory starts with one bucket; only a bucket over the byte
limit is split, on one bit more, until every shard fits. Splitting is decided from a histogram of bytes by hash prefix, a
dozen bits a round, so a round costs one aggregation with map-side combine whatever the number of splits; rows of buckets
that need still more bits go on to the next round alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, only

#: Bits of the key's hash, then as many of the row's content for rows whose keys are equal.
KEY_BITS = 60
ROUND_BITS = 12


def _bits(text: Column) -> Column:
    """The first 60 bits of a string's MD5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, (F.lit(KEY_BITS) - depth).cast("int"))


def _shifted(bits: str, by: int) -> Column:
    return F.call_function("shiftright", F.col(bits), F.lit(by))


def _name(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix), depth, "0"))


def _split(rows: DataFrame, limit: int, scratch: Scratch) -> tuple[DataFrame | None, DataFrame]:
    """Rows ``(id, bits, more, n_bytes)`` with their leaf's name, and those left over after the last bit."""
    done: DataFrame | None = None
    left = rows
    for low in range(0, KEY_BITS, ROUND_BITS):
        high = low + ROUND_BITS
        cells = left.groupBy(_prefix(F.col("bits"), high).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        cells = scratch.write(cells)
        # A bucket that the last round left has at most 2**12 cells; sums over them at each depth need no more rows.
        fits = lambda d: (F.sum("b").over(w := Window.partitionBy("bucket", _shifted("cell", high - d))) <= limit) | (F.sum("n").over(w) == 1)
        depth = F.coalesce(*(F.when(fits(d), d) for d in range(low + (low > 0), high + 1)))
        leaf = cells.withColumn("bucket", _shifted("cell", ROUND_BITS)).repartition("bucket").select("cell", depth.alias("depth")).where("depth is not null")
        leaf = scratch.write(leaf)
        keyed = left.withColumn("cell", _prefix(F.col("bits"), high))
        # The first round's table has 2**12 rows at most; later ones are as many as their buckets need.
        found = keyed.join(F.broadcast(leaf) if low == 0 else leaf, "cell", "left")
        name = _name(_prefix(F.col("bits"), F.col("depth")), F.col("depth"))
        here = found.where("depth is not null").select("id", "n_bytes", name.alias("shard"))
        done = here if done is None else done.unionByName(here)
        left = scratch.write(found.where("depth is null").select("id", "bits", "more", "n_bytes"))
        if left.isEmpty():
            return done, left
    return done, left


#: Equal rows that a task writes out at a time.
RUN_ROWS = 1 << 16


def _deal_equal(same: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Rows whose keys and contents agree, with a ``part`` that fits the limit or holds one row.

    Equal rows are counted before anything is shuffled and written out again from the counts, in runs, so no task holds them
    all. Rows of one content's bits differ in id and size only where hashes or a null and an empty id meet, so the window
    over their counts is of a few rows.
    """
    along = Window.partitionBy("id.bits", "bits").orderBy("id.id", "n_bytes")
    counted = same.groupBy("id", "bits", "n_bytes").agg(F.count("*").alias("n"))
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = F.max("n_bytes").over(Window.partitionBy("id.bits", "bits"))
    counted = scratch.write(counted.withColumn("per", F.greatest(F.floor(F.lit(limit) / F.greatest(each, F.lit(1))), F.lit(1)).cast("long")))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1), F.lit(RUN_ROWS).cast("long")))).repartition("id", "bits", "run")
    row = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN_ROWS, F.col("n")) - 1))
    rows = runs.select("id", "bits", "n_bytes", "before", "per", row.alias("row"))
    return rows.withColumn("part", F.floor((F.col("before") + F.col("row")) / F.col("per")).cast("long"))


def extendible_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit_bytes: int) -> DataFrame:
    """A shard for every row: ``(id, n_bytes, shard, depth, shard_bytes, shard_rows, oversized)``.

    ``shard`` is the shard's hash prefix as a string of bits, ``depth`` the number of bits (0, and '' as name, if all rows
    fit one shard). A row's size is that of its UTF-8 text; a null text has 0 bytes. A shard is over the limit only if it
    holds one row that is (``oversized``). Rows with equal ids, null ids included, share all bits of the key; if together
    they are over the limit they are split further on the bits of their text's hash (a name of 60 bits, '.', more bits),
    and rows that are equal throughout are dealt out in order (a further '.' and a number), as many to a shard as fit. Repeated rows each come out.
    An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.write(
        only(docs, id=id_col, text=text_col).select(
            "id",
            _bits(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("bits"),
            _bits(text).alias("more"),
            F.octet_length(text).cast("long").alias("n_bytes"),
        )
    )
    done, left = _split(rows, limit_bytes, scratch)
    if not left.isEmpty():
        # Equal keys: the content's bits take over, within the key.
        inner = left.select(F.struct("id", "bits").alias("id"), F.expr("xxhash64(bits, more) & 1152921504606846975").alias("bits"), "more", "n_bytes")
        deeper, same = _split(inner, limit_bytes, scratch)
        key = _name(F.col("id.bits"), F.lit(KEY_BITS))
        done = done.unionByName(deeper.select("id.id", "n_bytes", F.concat(key, F.lit("."), "shard").alias("shard")))
        if not same.isEmpty():
            content = _name(F.col("bits"), F.lit(KEY_BITS))
            name = F.concat(key, F.lit("."), content, F.lit("."), F.col("part").cast("string"))
            done = done.unionByName(_deal_equal(same, limit_bytes, scratch).select("id.id", "n_bytes", name.alias("shard")))
    sizes = done.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    depth = F.length(F.regexp_replace("shard", r"\.", "")).cast("int").alias("depth")
    over = ((F.col("shard_rows") == 1) & (F.col("shard_bytes") > limit_bytes)).alias("oversized")
    return done.join(sizes, "shard").select("id", "n_bytes", "shard", depth, "shard_bytes", "shard_rows", over)


def directory(shards: DataFrame) -> DataFrame:
    """The directory of ``extendible_shards``' result: ``(shard, depth, first, last)``.

    ``first`` and ``last`` bound the 60-bit hash values that lead to the shard, so a key's shard is found by comparing its
    hash; this is the directory without its repeated entries. Names of more than 60 bits are left out.
    """
    known = shards.where(F.col("depth") <= KEY_BITS).select("shard", "depth").distinct()
    prefix = F.coalesce(F.conv(F.when(F.col("shard") != "", F.col("shard")), 2, 10).cast("long"), F.lit(0))
    first = F.expr(f"shiftleft(p, {KEY_BITS} - depth)")
    last = F.expr(f"shiftleft(p + 1, {KEY_BITS} - depth) - 1")
    return known.withColumn("p", prefix).select("shard", "depth", first.alias("first"), last.alias("last"))
