"""Linear-time folds and look-ups inside one row's arrays.

Appending to an array copies it, so a fold that appends for every element takes time in the
square of the length. Here a fold appends inside blocks of ``BLOCK`` elements and then block by block, and membership
is decided by sorting, not by one search per element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(arr: Column, size: int = BLOCK) -> Column:
    """The array cut into arrays of ``size`` elements (the last one may be shorter); null stays null."""
    def cut(a: Column) -> Column:
        firsts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda at: F.slice(a, at + 1, size))
    return let(arr, cut)


def fold_map(arr: Column, zero: Column, emits: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The array of what ``step(state, element) -> (state, out)`` puts out, from left to right, starting with the
    state ``zero``; ``emits`` is the type of ``out``. Time is linear for any length in use (blocks of blocks)."""
    def inside(block: Column, state: Column) -> Column:
        def one(acc, x):
            new, out = step(acc["s"], x)
            return F.struct(new.alias("s"), F.concat(acc["out"], F.array(out.cast(emits))).alias("out"))
        return F.aggregate(block, F.struct(state.alias("s"), F.array().cast(f"array<{emits}>").alias("out")), one)

    def outside(acc, block):
        return let(inside(block, acc["s"]), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(zero.alias("s"), F.array().cast(f"array<array<{emits}>>").alias("out"))
    return F.aggregate(blocks(arr), start, outside, lambda acc: F.flatten(acc["out"]))


def member_flags(arr: Column, others: Column) -> Column:
    """For every string of ``arr`` whether it is one of ``others``: both sorted into one array, a value's
    copy in ``others`` comes right before its places in ``arr``. Nulls are in none."""
    both = F.array_sort(F.concat(F.transform(others, lambda x: F.struct(x.alias("v"), F.lit(-1).alias("i"))),
                                 F.transform(arr, lambda x, i: F.struct(x.alias("v"), i.alias("i")))))
    marked = fold_map(both, F.lit(None).cast("string"), "struct<i:int,known:boolean>", lambda last, x: (
        F.when(x["i"] < 0, x["v"]).otherwise(last), F.struct(x["i"].alias("i"), F.coalesce(x["v"] == last, F.lit(False)).alias("known"))))
    return F.transform(F.array_sort(F.filter(marked, lambda x: x["i"] >= 0)), lambda x: x["known"])
