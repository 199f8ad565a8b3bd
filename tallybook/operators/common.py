"""Small building blocks used across the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_A_TASK = 250_000
MOST_LEFT_TO_SPARK = 500_000  # rows of a side table; a join with more is a shuffled hash join


def tasks_for(spark: SparkSession, rows: int, each: int = ROWS_A_TASK) -> int:
    """A number of tasks that leaves each a bounded number of rows, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Rows dealt by key over exactly so many tasks.

    A shuffle that Spark inserts by itself is merged afterwards into a few partitions of tens of compressed MB, of which
    sorts and hash tables make a GB or more a task; one of a given number is left as it is.
    """
    return df.repartition(tasks, *keys)


def looked_up(side: DataFrame, rows: int | None = None) -> DataFrame:
    """The side table of a join by key, few columns wide, as the one to be hashed: the larger table is streamed, not sorted.

    Of a known number of ``rows`` up to half a million Spark chooses by itself, so that small tables are broadcast. A hot key
    of the larger table can still be split by the adaptive skew join.
    """
    return side if rows is not None and rows <= MOST_LEFT_TO_SPARK else side.hint("shuffle_hash")


def percent(part, whole, digits: int | None = 1) -> Column:
    """100 * part / whole; null when the whole is zero or null."""
    value = F.try_divide(F.lit(100.0) * _col(part), _col(whole))
    return value if digits is None else half_up(value, digits)


def ratio(part, whole, digits: int | None = 1) -> Column:
    value = F.try_divide(_col(part).cast("double"), _col(whole))
    return value if digits is None else half_up(value, digits)


def half_up(value: Column, digits: int) -> Column:
    """Half-up rounding of a quotient; the inner step lifts ties that binary division left a hair below."""
    return F.round(F.round(value, 9), digits)


def fixed(value, digits: int) -> Column:
    """Number as text with a fixed count of decimals; null stays null."""
    return F.when(_col(value).isNotNull(), F.format_string(f"%.{digits}f", half_up(_col(value), digits)))


def number(value) -> Column:
    """Text to number, null where the text is a mask or not numeric."""
    return F.expr(f"try_cast(`{value}` AS double)")


def blank_to_null(value) -> Column:
    return F.nullif(F.trim(_col(value)), F.lit(""))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that pairs null keys and keeps one copy of them.

    Group statistics are attached with this instead of a window: the statistics side is partially
    aggregated before its shuffle, and both inputs of the join sit directly on an exchange, so the
    adaptive skew join can split a hot key that a window would sort in a single task.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Every row together with aggregates of its key group (null is a group of its own)."""
    return null_safe_join(df, df.groupBy(*keys).agg(*aggregates), keys, "inner")


def one_value(df: DataFrame, aggregate: Column) -> Column:
    """A one-row aggregate as a scalar subquery: planned and run once, no join."""
    return df.select(aggregate).scalar()


def every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def either(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)
