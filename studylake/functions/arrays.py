"""Folds over the elements of an array that keep a running position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are appended one by one before they are put aside as a whole.
CHUNK = 256


def running(items: Column | str, advance: Callable[[Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(item, position)`` of each element, where the position is the sum of ``advance`` over the elements before; nulls
    are left out. ``kind`` is the type of what is emitted.

    An array that grows by one element a step is copied each time, which takes time in the square of its length. Here
    ``CHUNK`` elements grow at a time and finished chunks are put aside, so a step costs the same in arrays of any length.
    """
    zero = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done")
    )

    def step(acc: Column, x: Column) -> Column:
        made = emit(x, acc["at"])
        full = F.size(acc["now"]) >= CHUNK
        one = F.array(made.cast(kind))
        now = F.when(made.isNull(), acc["now"]).when(full, one).otherwise(F.concat(acc["now"], one))
        done = F.when(made.isNotNull() & full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct((acc["at"] + advance(x)).cast("long").alias("at"), now.alias("now"), done.alias("done"))

    return F.aggregate(items, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))


def starts(lengths: Column | str) -> Column:
    """Sum of the lengths before each element."""
    return running(lengths, lambda n: n, lambda _, at: at, "bigint")
