"""Changes to stored tables as joins.

Parquet tables have no MERGE, UPDATE or DELETE: a change reads the table and gives its next state, which a commit of
``commits.Log`` puts in place of the present one.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str, keep_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Source rows overwrite or extend the target (SNK-3, SNK-5); a null leaves the old value in ``keep_old_if_null`` (SNK-4)."""
    s, t = source.alias("s"), target.alias("t")
    matched = F.col(f"s.{key}").isNotNull()

    def value(c: str) -> Column:
        new = F.coalesce(f"s.{c}", f"t.{c}") if c in keep_old_if_null else F.col(f"s.{c}")
        return F.when(matched, new).otherwise(F.col(f"t.{c}")).alias(c)

    rest = [value(c) for c in target.columns if c != key]
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), *rest)


def insert_or_ignore(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Source rows with new keys are added (SNK-2)."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(*target.columns))


def patch(target: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Change the fields that a patch sets, to null too (SNK-7, ART-9). ``changes`` has ``<field>_set`` beside each field."""
    c, t = changes.alias("c"), target.alias("t")
    value = lambda f: F.when(F.col(f"c.{f}_set"), F.col(f"c.{f}")).otherwise(F.col(f"t.{f}")).alias(f)
    return t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "left").select(*(value(x) if x in fields else F.col(f"t.{x}") for x in target.columns))


def replace_children(target: DataFrame, source: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``source`` give way to its rows, without repeats (SNK-6)."""
    kept = target.join(source.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(source.select(*target.columns).distinct())


def joined_children(children: DataFrame, parent: str, value: str, name: str) -> DataFrame:
    """Children of a parent as one sorted string (SNK-6)."""
    return children.groupBy(parent).agg(F.array_join(F.array_sort(F.collect_set(value)), " ").alias(name))


def cascade_delete(tables: dict[str, DataFrame], start: str, gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Delete rows and all that refers to them (SNK-8).

    ``gone`` holds keys of ``start`` to delete, under the key's name. A link is (parent, parent's key, child, child's column),
    parents before children.
    """
    key = gone.columns[0]
    out = dict(tables)
    out[start] = tables[start].join(gone, key, "left_anti")
    lost = {start: tables[start].join(gone, key, "left_semi")}
    for parent, parent_key, child, column in links:
        if parent not in lost:
            continue
        keys = lost[parent].select(F.col(parent_key).alias(column)).distinct()
        lost[child] = out[child].join(keys, column, "left_semi")
        out[child] = out[child].join(keys, column, "left_anti")
    return out


def set_null_on_delete(members: DataFrame, groups_left: DataFrame, column: str, group_key: str) -> DataFrame:
    """References to groups that are gone become null (SNK-9)."""
    known = groups_left.select(F.col(group_key).alias("__group")).distinct()
    joined = members.join(known, members[column] == F.col("__group"), "left")
    return joined.withColumn(column, F.when(F.col("__group").isNotNull(), F.col(column))).drop("__group")


def purge(df: DataFrame, expiry: str, as_of: Column) -> DataFrame:
    """Rows that have not expired (SNK-10, FLT-8)."""
    return df.where(F.col(expiry) > as_of)


def cancel_jobs(jobs: DataFrame, reason: str) -> DataFrame:
    """Queued and running jobs become cancelled, with a reason (SNK-13)."""
    live = F.col("status").isin("queued", "running")
    return jobs.withColumn("error", F.when(live, reason).otherwise(F.col("error"))).withColumn("status", F.when(live, "cancelled").otherwise(F.col("status")))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; it goes when the interpreter ends.

    Without that setting a local session takes a temporary folder, and one on a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/studylake-checkpoints"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is computed once, however often it is read, in a ``shared_folder``."""
    spark, schema = df.sparkSession, df.schema
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more, and the shuffles of finished queries: Spark deletes these when
    the driver's JVM collects what referred to them, which a large heap may put off until the disk is full."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def expiry(start: Column, days: int = 30) -> Column:
    """When something that started then expires (TIME)."""
    return start + F.make_dt_interval(F.lit(days))
