"""Relational operators of a reading library: newest rows, counts that keep zeros, neighbours, sequences, folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``, with all its columns (JN-4, JN-10, JN-15, SRT-7).

    ``row_number`` under a filter plans as a group limit: each partition keeps a row a key before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def newest_or_default(left: DataFrame, right: DataFrame, key: str, version: str, values: dict[str, Column]) -> DataFrame:
    """Every left row with the newest right row's values, or defaults where there is none (JN-5, AGG-6, ED-10).

    ``values`` maps a column of ``right`` to its default. The newest row comes from an aggregation, so at most one row a key
    and task is shuffled.
    """
    best = F.max_by(F.struct(version, *values), version).alias("__best")
    latest = right.groupBy(key).agg(best)
    joined = left.join(latest, key, "left")
    filled = [F.coalesce(F.col(f"__best.{c}"), default).alias(c) for c, default in values.items()]
    return joined.select(*left.columns, F.coalesce(F.col(f"__best.{version}"), F.lit(0)).cast("long").alias("revision"), *filled)


def counts_with_zero(groups: DataFrame, members: DataFrame, group_key: str, member_key: str, name: str) -> DataFrame:
    """Every group with the number of its members, zero too (JN-9, AGG-2). Members are counted before the join."""
    counted = members.groupBy(F.col(member_key).alias("__key")).agg(F.count("*").alias("__n"))
    joined = groups.join(counted, groups[group_key] == F.col("__key"), "left")
    return joined.select(*groups.columns, F.coalesce("__n", F.lit(0)).cast("long").alias(name))


def count_per_row(df: DataFrame, other: DataFrame, key: str, name: str, condition: Column | None = None) -> DataFrame:
    """A correlated count as an aggregation and a left join (AGG-1)."""
    chosen = other if condition is None else other.where(condition)
    counted = chosen.groupBy(key).agg(F.count("*").cast("long").alias(name))
    return df.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def all_or_newest(df: DataFrame, keys: list[str], version: str, kind: str, singletons: list) -> DataFrame:
    """All rows, but of the ``singletons`` kinds the newest version a key alone (FLT-3, ART-2)."""
    top = F.max(version).over(Window.partitionBy(*keys))
    return df.withColumn("__top", top).where(~F.col(kind).isin(singletons) | (F.col(version) == F.col("__top"))).drop("__top")


def neighbours(df: DataFrame, key: str, ordinal: str, text: str, name: str, reach: int = 1) -> DataFrame:
    """Texts from ``reach`` places before to ``reach`` after each row, joined by line breaks (JN-17, FLT-4, AGG-13, CTX-4)."""
    w = Window.partitionBy(key).orderBy(ordinal).rangeBetween(-reach, reach)
    return df.withColumn(name, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text)).over(w)), lambda s: s[text]), "\n"))


def next_version(keys: DataFrame, df: DataFrame, key: str, version: str, name: str = "next_version") -> DataFrame:
    """One more than the highest version of each key, 1 where there is none (AGG-5); versions may have gaps."""
    top = df.groupBy(key).agg(F.max(version).alias("__top"))
    return keys.join(top, key, "left").select(key, (F.coalesce("__top", F.lit(0)) + 1).cast("long").alias(name))


def messages_json(df: DataFrame, key: str, order: str, fields: list[str], name: str = "messages") -> DataFrame:
    """Rows of a key as a JSON array of objects, in order inside the array (AGG-7)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("row"))))
    objects = F.transform(rows, lambda r: r["row"])
    return df.groupBy(key).agg(F.count("*").cast("long").alias("n_messages"), F.to_json(objects).alias(name))


def numbered(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 within their key by ``order``, for keys of any size.

    Rows are sorted into ranges, numbered within a range, and moved up by the rows of the key in the ranges before: a window
    over the key alone would hold all its rows in one task. ``order`` is unique within a key.
    """
    ranged = written(df.repartitionByRange(key, order).withColumn("__range", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.select(F.col(key).alias("__key"), F.col("__range").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(key, "__range").orderBy(order))
    placed = ranged.withColumn(name, own).join(moved, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__at")))
    return placed.withColumn(name, (F.col(name) + F.col("__before")).cast("long")).select(*df.columns, name)


def first_value(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The value of each key's first row (AGG-8)."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def mean_where(df: DataFrame, key: str, value: str, name: str, condition: Column) -> DataFrame:
    """Mean of the values that are known under a condition, over all time (AGG-4)."""
    return df.where(condition & F.col(value).isNotNull()).groupBy(key).agg(F.round(F.avg(value), 6).alias(name))


def filtered(df: DataFrame, given: dict[str, object], rules: dict) -> DataFrame:
    """AND of the predicates whose parameter was given; a blank or null parameter is none (FLT-9, FTS-9)."""
    predicates = [rules[k](v) for k, v in given.items() if v not in (None, "")]
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def existing(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a match, each once (FLT-12, ANC-9)."""
    return df.join(other.select(*keys).distinct(), keys, "left_semi")


def range_strings(column: str, low: str | None, high: str | None) -> Column:
    """Bounds compared as text, both included; a date alone as upper bound leaves out times of that day (FLT-7)."""
    value = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return (value >= low if low else F.lit(True)) & (value <= high if high else F.lit(True))


def grouped_or_rest(df: DataFrame, groups: DataFrame, key: str, group_id: str, name: str, rest: str) -> DataFrame:
    """Rows with their group's name, or ``rest`` for those without a group (JN-21)."""
    named = groups.select(F.col(group_id).alias("__id"), F.col(name).alias("__name"))
    return df.join(named, F.col(key) == F.col("__id"), "left").withColumn(name, F.coalesce("__name", F.lit(rest))).drop("__id", "__name")
