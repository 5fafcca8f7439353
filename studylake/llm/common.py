"""Helpers that the training-data operators share: scratch tables, column names that cannot clash, connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under internal names, so that whatever else ``df`` holds cannot clash with them."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}") not in taken)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidy(run):
    """An Arrow function that gives freed memory back to the system when its task ends: Python workers are reused, and
    what an idle one keeps is missing from the executor."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir``, the folder that driver and executors share.

    Writing a table and reading it again cuts lineage in a form that survives lost executors. ``drop`` removes a table as
    soon as nothing reads it; the rest goes when the driver's interpreter ends. Without the setting a local session takes a
    temporary folder, and one on a cluster is refused.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            root = f"{tempfile.gettempdir()}/studylake-checkpoints"
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[str] = []
        atexit.register(self.clear)

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return it as read back; ``drop`` accepts the result."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        schema = df.schema
        df.write.parquet(path)
        # A table without rows has no part files to infer a schema from.
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def write_dealt(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """``write`` in buckets by ``key``, so that a join on it with as many partitions leaves these rows where they are."""
        name, path = f"scratch_{uuid.uuid4().hex}", f"{self.root}/{self.count}"
        self.count += 1
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            self._delete(path)

    def clear(self) -> None:
        try:
            for name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._delete(self.root)
        except Exception:  # the JVM may be gone when the interpreter ends
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


#: A key that holds more than one in ``HUBS`` of the rows is a hub; with fewer than ``HUB_ROWS`` rows none is.
HUBS, HUB_ROWS = 4096, 1024


def with_least(rows: DataFrame, key: str, value: str, least: str, count: int, scratch: Scratch) -> DataFrame:
    """``rows`` with the smallest ``value`` of all rows of the same ``key`` in a column ``least``.

    The smallest values come from map-side combine. A join would then bring all rows of a key into one task, so hubs are
    set apart: at most ``HUBS`` keys can have that many of the ``count`` rows, which is what bounds the broadcast, and rows
    of a hub stay where they are. ``rows`` is read three times, so it should be a table or a projection of one.
    """
    found = scratch.write(rows.groupBy(key).agg(F.min(value).alias(least), F.count("*").alias("many")))
    big = found.where(F.col("many") > max(HUB_ROWS, count // HUBS)).drop("many")
    if big.isEmpty():
        return rows.join(found.drop("many"), key)
    hubs = F.broadcast(big)
    return rows.join(hubs, key).unionByName(rows.join(hubs.drop(least), key, "left_anti").join(found.drop("many"), key))


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Smallest node of the component for every node that has an edge to another: ``(node, root)``.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set stands still, in a number of
    rounds logarithmic in the longest path. Each step is an aggregation with map-side combine and ``with_least``, which
    does not gather the edges of a hub; no neighbourhood is ever collected.
    """
    x, y = F.col(a), F.col(b)
    now = scratch.write(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = with_least(both, "u", "v", "m", 2 * state[0], scratch).where("v > u")
        large = scratch.write(stars.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        stars = with_least(large, "u", "v", "m", 2 * state[0], scratch)
        # The edge to the smallest node links the star's centre to it, all others link their ends to it.
        small = stars.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        then = scratch.write(small.distinct())
        before, state = state, _state(then)
        scratch.drop(now)
        scratch.drop(large)
        now = then
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def words_of(text: Column) -> Column:
    """Lower-cased words of a text, as an array without empty strings; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
