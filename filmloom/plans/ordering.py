"""Ordered computations that stay parallel when one key holds a large share of the rows.

A plain ``Window.partitionBy(video)`` puts a whole video in one task. The helpers here cut a
key into buckets (ranges of the ordering column), work inside each bucket, and carry what
later buckets need through a table with one row per bucket. That table is summed on three
levels, each a thousandth of the one before, so neither one key's nor all buckets meet in one task.

Nulls are values: a null key is a key, and null buckets and orders come first, as in an
ascending sort. No row is lost or counted twice.

The input is read twice, at first, when the plan is built, for the bucket totals with only the key columns; so an input
that is expensive to compute should be written first (``plans.storage.write_through``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from filmloom.plans.storage import write_through

DEFAULT_BLOCK = 65_536  # rows per bucket; the table carried over has one row for each
FAN = 1_024  # buckets under one bucket of the level above
ONE_LEVEL = 65_536  # buckets of all keys that one window may hold


def _tag(df: DataFrame, buckets: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"__bucket{i}" for i in range(len(buckets))]
    return df.select("*", *[b.alias(n) for b, n in zip(buckets, names)]), names


def _with_levels(table: DataFrame, first: str) -> DataFrame:
    """Two coarser versions of the first bucket column; both never decrease along it."""
    if isinstance(table.schema[first].dataType, NumericType):
        return table.withColumn("__mid", F.floor(F.col(first) / FAN)).withColumn("__top", F.floor(F.col("__mid") / FAN))
    text = F.col(first).cast("string")
    return table.withColumn("__mid", F.substring(text, 1, 2)).withColumn("__top", F.substring(text, 1, 1))


def join_on(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``names``, where null equals null; the right side's copies are dropped."""
    if not names:
        return left.join(right, how=how)
    other = right.withColumnsRenamed({n: f"__right_{i}" for i, n in enumerate(names)})
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"__right_{i}")) for i, n in enumerate(names)])
    return left.join(other, same, how).drop(*[f"__right_{i}" for i in range(len(names))])


def _carried(
    table: DataFrame, keys: list[str], names: list[str], values: Sequence[str],
    add_up: Callable[[str], Column], before: Callable[[str, object], Column], both: Callable[[str, Column, Column], Column],
) -> DataFrame:
    """For every bucket, each value folded over all earlier buckets of its key.

    ``add_up`` aggregates a value, ``before`` folds it over a window of earlier rows, ``both`` puts an earlier and a
    later fold together. The table has one row per bucket and is written before, so the input is read once for it and the
    levels run over few rows. Up to ``ONE_LEVEL`` rows one window does all; the result is the same either way.
    """
    if table.count() <= ONE_LEVEL:
        window = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        return table.select(*keys, *names, *[before(v, window).alias(v) for v in values])
    levels = [keys + ["__top"], keys + ["__top", "__mid"], keys + ["__top", "__mid", *names]]
    table = _with_levels(table, names[0])
    out, passed = None, keys
    for level in levels:
        new = [c for c in level if c not in passed]
        totals = table if level is levels[-1] else table.groupBy(*level).agg(*[add_up(v).alias(v) for v in values])
        window = Window.partitionBy(*passed).orderBy(*new).rowsBetween(Window.unboundedPreceding, -1)
        folded = totals.select(*level, *[before(v, window).alias(f"{v}_in") for v in values])
        if out is None:
            out = folded.select(*level, *[F.col(f"{v}_in").alias(v) for v in values])
        else:
            out = join_on(folded, out, passed).select(*level, *[both(v, F.col(v), F.col(f"{v}_in")).alias(v) for v in values])
        passed = level
    return out.drop("__top", "__mid")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    buckets: Sequence[Column],
    name: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """0-based position of every row of a key, without one task per key.

    ``buckets`` must be non-decreasing along ``order`` (a prefix of the order, a coarser
    version of it, or both) and are compared left to right. ``total`` adds the key's row count.
    """
    keys = list(keys)
    tagged, names = _tag(df, buckets)
    counted = write_through(tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n")), "bucket-totals")
    offsets = _carried(
        counted, keys, names, ["__n"], F.sum, lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0)), lambda _, a, b: a + b
    ).withColumnRenamed("__n", "__offset")
    if total:
        offsets = join_on(offsets, counted.groupBy(*keys).agg(F.sum("__n").alias(total)), keys)
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    numbered = tagged.withColumn("__rank", F.row_number().over(inside))
    out = join_on(numbered, offsets, [*keys, *names])
    return out.withColumn(name, F.col("__offset") + F.col("__rank") - 1).select(
        *df.columns, name, *([total] if total else [])
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    block: Column,
    **specs: tuple[str, Column],
) -> DataFrame:
    """Running ``sum``, ``max`` or ``last`` (non-null) up to each row, in ``order`` within keys.

    ``block`` must be non-decreasing along ``order``, for instance ``line_no div 65536``.
    A spec is ``name=(kind, column)``; the kind ``sum_before``/``max_before`` leaves out the row itself.
    Rows with nothing to add should be null rather than 0: they are then left out of the totals.
    """
    keys = list(keys)
    tagged = df.select(
        "*", block.alias("__block"), *[c.alias(f"__v_{n}") for n, (_, c) in specs.items()]
    )
    kinds = {f"__t_{n}": kind for n, (kind, _) in specs.items()}

    def total(kind: str, n: str) -> Column:
        v = F.col(f"__v_{n}")
        if kind == "last":  # a null order is the earliest, a null value is none
            return F.max_by(v, F.when(v.isNotNull(), F.struct(F.col(order).isNotNull(), order)))
        return F.sum(v) if kind.startswith("sum") else F.max(v)

    # Null values add nothing, so only rows with a value are aggregated; every block is still listed.
    has_value = reduce(or_, [F.col(f"__v_{n}").isNotNull() for n in specs])
    totals = tagged.filter(has_value).groupBy(*keys, "__block").agg(
        *[total(k, n).alias(f"__t_{n}") for n, (k, _) in specs.items()]
    )
    blocks = write_through(join_on(tagged.select(*keys, "__block").distinct(), totals, [*keys, "__block"], "left"), "bucket-totals")

    def fold(kind: str, col: str, w) -> Column:
        if kind == "last":
            return F.last(col, ignorenulls=True).over(w)
        return (F.sum if kind.startswith("sum") else F.max)(col).over(w)

    def add_up(v: str) -> Column:
        if kinds[v] == "last":
            return F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(F.col("__block").isNotNull(), "__block")))
        return (F.sum if kinds[v].startswith("sum") else F.max)(v)

    def both(v: str, earlier: Column, later: Column) -> Column:
        if kinds[v] == "last":
            return F.coalesce(later, earlier)
        if kinds[v].startswith("sum"):
            return F.coalesce(earlier, F.lit(0)) + F.coalesce(later, F.lit(0))
        return F.greatest(earlier, later)

    carried = _carried(blocks, keys, ["__block"], list(kinds), add_up, lambda v, w: fold(kinds[v], v, w), both)
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select(
        "*",
        *[
            fold(k, f"__v_{n}", prior if k.endswith("before") else upto).alias(f"__l_{n}")
            for n, (k, _) in specs.items()
        ],
    )

    return join_on(local, carried, [*keys, "__block"]).select(
        *[F.col(c) for c in df.columns], *[both(f"__t_{n}", F.col(f"__t_{n}"), F.col(f"__l_{n}")).alias(n) for n in specs]
    )


def with_halo(
    df: DataFrame, index: str, size: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Cut a dense index into segments and copy edge rows to the neighbours that look at them.

    Adds ``segment`` and ``is_own``. A window over ``(key, segment)`` then sees up to
    ``before`` earlier and ``after`` later rows; keep only ``is_own`` rows afterwards.
    Copies are ``(before + after) / size`` of the rows, so no key needs a task of its own.
    A row with a null index has no neighbours: it fails the query.
    """
    if max(before, after) > size:
        raise ValueError("a halo may not be longer than a segment")
    known = F.coalesce(F.col(index), F.raise_error(F.lit(f"{index} is null in a dense index")).cast("bigint"))
    own = F.floor(known / size)
    rest = F.col(index) % size
    targets = [own]
    if before:
        targets.append(F.when(rest >= size - before, own + 1))
    if after:
        targets.append(F.when((rest < after) & (own > 0), own - 1))
    return (
        df.withColumn("segment", F.explode(F.array(*targets)))
        .filter(F.col("segment").isNotNull())
        .withColumn("is_own", F.col("segment") == own)
    )
