"""Expressions on arrays whose work grows with the array, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements of a block of running sums.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column) -> Column:
    """For each number of an array the sum of those before it; nulls count as 0, an empty array gives an empty one.

    Sums are taken inside blocks and over the sums of blocks, as appending to an array
    copies it.
    """
    number = F.lit(0).cast("bigint")

    def total(x: Column) -> Column:
        return F.aggregate(x, number, lambda a, v: a + F.coalesce(v, F.lit(0)))

    def sums(blocks: Column) -> Column:
        ends = F.aggregate(blocks, F.array(number), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + total(x))))
        return let(ends, lambda e: F.flatten(F.transform(blocks, lambda x, b: F.transform(x, lambda v, i: F.get(e, b) + total(F.slice(x, F.lit(1), i))))))

    def cut(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(v) > 0, let(blocks, sums)).otherwise(F.array().cast("array<bigint>"))

    return let(values, cut)
