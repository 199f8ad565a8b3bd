"""Statistical disclosure control on published tables.

Masked cells are coded -1 (X: small) and -2 (Y: the complement is small) in numeric columns and only
turned into text by ``masks_to_text``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import count_if, number, one_value, percent, with_group_stats
from .totals import triple_totals

CUTOFF = 6
Triple = tuple[str, str, str]


def _small(value: Column, cutoff) -> Column:
    return (value > 0) & (value < cutoff)


def suppress_small(table: DataFrame, total: str = "total", percentage: str | None = None, limit: int = CUTOFF) -> DataFrame:
    """Totals below the limit become 0 with mark X; their percentage becomes 0."""
    small = F.col(total) < limit
    out = table.withColumn("anon", F.when(small, "X").otherwise(""))
    if percentage is not None:
        out = out.withColumn(percentage, F.when(small, 0.0).otherwise(F.col(percentage)))
    return out.withColumn(total, F.when(small, 0).otherwise(F.col(total)))


def suppress_triple(table: DataFrame, triple: Triple, cutoff: int | Column = CUTOFF) -> DataFrame:
    """Mask a (whole, part, per cent) triple; the whole is masked before the difference is taken."""
    whole, part, per = triple
    table = table.withColumn(whole, F.when(_small(F.col(whole), cutoff), -1).otherwise(F.col(whole)))
    rest = F.col(whole) - F.col(part)
    table = table.withColumn(
        part, F.when(_small(F.col(part), cutoff), -1).when(_small(rest, cutoff), -2).otherwise(F.col(part))
    )
    return table.withColumn(
        per, F.when(F.col(part).isin(-1, -2), F.col(part).cast("double")).otherwise(F.round(per, 1))
    )


def suppress_triple_by_providers(table: DataFrame, triple: Triple, providers: str, cutoff: int = CUTOFF) -> DataFrame:
    """As ``suppress_triple`` with the threshold raised by the number of providers."""
    return suppress_triple(table, triple, F.col(providers) + (cutoff - 1))


def suppress_cross(table: DataFrame, first: Triple, second: Triple, cutoff: int = CUTOFF) -> DataFrame:
    """Mask the second triple where it leaves a small remainder of the first."""
    a, b, _ = first
    x, y, z = second
    table = table.withColumn(x, F.when(_small(F.col(a) - F.col(x), cutoff), -2).otherwise(F.col(x)))
    table = table.withColumn(y, F.when(_small(F.col(b) - F.col(y), cutoff), -2).otherwise(F.col(y)))
    return table.withColumn(z, F.when(F.col(y) == -2, -2.0).otherwise(F.round(z, 1)))


def five(value: Column) -> Column:
    """6 and 7 to 6, masks and 1..5 unchanged, anything else to the nearest 5."""
    return (
        F.when(value.isin(6, 7), 6)
        .when(value.isin(-1, -2, 1, 2, 3, 4, 5), value)
        .otherwise((F.round(value / 5) * 5).cast("long"))
    )


def round_to_five(table: DataFrame, triple: Triple) -> DataFrame:
    whole, part, per = triple
    table = table.withColumn(whole, five(F.col(whole))).withColumn(part, five(F.col(part)))
    return table.withColumn(
        per,
        F.when(F.col(whole) == 0, 0.0)
        .when(F.col(part).isin(-1, -2, 0), F.col(part).cast("double"))
        .otherwise(percent(part, whole, 1)),
    )


@dataclass(frozen=True)
class Layout:
    """Shape of a published table: which triples it has and in which order the steps run."""

    labels: Sequence[str]
    triples: Sequence[Triple]
    extra_sums: Sequence[str] = ()
    providers: str | None = None  # provider count, for tables by authority
    round_first: bool = True  # round then suppress; wide tables suppress then round


def layout(name: str, columns: Sequence[str], by_authority: bool = False) -> Layout:
    """The named layouts (five .. ten) over a table's columns in order."""
    labels = {"five": 2, "six": 3, "seven": 1, "eight": 2, "nine": 3, "ten": 4}[name]
    rest = list(columns[labels:])
    triples = [tuple(rest[i:i + 3]) for i in range(0, len(rest), 3)]
    if name in ("nine", "ten"):
        extras = list(columns[1:labels])
        return Layout([columns[0]], triples, extras, extras[-1] if by_authority else None, False)
    return Layout(list(columns[:labels]), triples)


def anonymise_table(
    table: DataFrame, shape: Layout, size: int | None = None, rows: int | None = None, cutoff: int = CUTOFF
) -> DataFrame:
    """Round and suppress a table, add totals of the rounded unsuppressed values, turn masks to text.

    With ``size`` and ``rows`` only rows with a large enough part are kept (best-provision lists).
    The table is computed once and stored; its body and its totals are both read from there.
    """
    table = stored(table.filter(F.col(shape.labels[0]).isNotNull()), "published")
    rounded = table
    for triple in shape.triples:
        rounded = round_to_five(rounded, triple)
    totals = triple_totals(rounded, shape.labels, shape.triples, shape.extra_sums)

    def suppress(df: DataFrame) -> DataFrame:
        for triple in shape.triples:
            df = suppress_triple(df, triple, cutoff)
        if len(shape.triples) == 2:
            df = suppress_cross(df, *shape.triples, cutoff=cutoff)
        if shape.providers is not None:
            for triple in shape.triples:
                df = suppress_triple_by_providers(df, triple, shape.providers, cutoff)
        return df

    if shape.round_first:
        body = suppress(rounded)
    else:
        body = suppress(table)
        for triple in shape.triples:
            body = round_to_five(body, triple)
    if size is not None:
        body = body.filter(F.col(shape.triples[-1][1]) >= size)
    if rows is not None:
        body = body.orderBy(F.desc(shape.triples[-1][2]), *shape.labels).limit(rows)
    percents = [t[2] for t in shape.triples]
    counts = [*shape.extra_sums, *[c for t in shape.triples for c in t[:2]]]
    out = masks_to_text(body, counts, percents).unionByName(masks_to_text(totals, counts, percents))
    return out.select(*table.columns)


def year_on_year(table: DataFrame, first: Triple, second: Triple, cutoff: int = CUTOFF) -> DataFrame:
    """The year-on-year layout: the first triple is rounded, the second suppressed, and there are no totals."""
    masked = suppress_triple(round_to_five(table, first), second, cutoff)
    return masks_to_text(masked, [*first[:2], *second[:2]], [first[2], second[2]])


def masks_to_text(table: DataFrame, counts: Sequence[str], percents: Sequence[str]) -> DataFrame:
    """-1 to X, -2 to Y, null stays null, everything else to text."""
    for c in counts:
        table = table.withColumn(c, F.when(F.col(c) == -1, "X").when(F.col(c) == -2, "Y").otherwise(F.col(c).cast("string")))
    for c in percents:
        table = table.withColumn(c, F.when(F.col(c) == -1, "X").when(F.col(c) == -2, "Y").when(F.col(c).isNotNull(), F.format_string("%.1f", c)))
    return table


def round_if_any_small(table: DataFrame, students: str, providers: str, groups: Sequence[str] = ()) -> DataFrame:
    """If any row with takers has nearly as many providers as takers, round all takers to 5 (at least 5).

    With ``groups`` this is decided for each of them. ``table`` is read twice: hand in a stored one.
    """
    close = (F.col(students) != 0) & (F.col(providers) > F.col(students) - 6)
    any_close = F.coalesce(F.max(close), F.lit(False)).alias("__any_close")
    if groups:
        table = with_group_stats(table, groups, any_close)
        rounds = F.col("__any_close")
    else:
        rounds = one_value(table, any_close)
    nearest = F.greatest((F.round(F.col(students) / 5) * 5).cast("long"), F.lit(5))
    return table.withColumn(
        students, F.when(rounds & (F.col(students) != 0), nearest).otherwise(F.col(students))
    ).drop("__any_close")


def mask_small_groups(
    table: DataFrame, rules: Sequence[tuple[str, str, str]], exempt: Column
) -> DataFrame:
    """For each (column, providers, students): text, masked where providers > students - 5 ("0" for none).

    ``exempt`` rows keep their values; conditions look at the table as it was before masking.
    """
    masked = {}
    for column, providers, students in rules:
        close = (F.col(providers) > F.col(students) - 5) & F.col(students).isNotNull() & ~exempt
        masked[column] = F.when(close & (F.col(students) == 0), "0").when(close, "X").otherwise(F.col(column).cast("string"))
    return table.withColumns(masked)


def ceil_to(value: Column, step: int = 5) -> Column:
    return (F.ceil(value / step) * step).cast("long")


def mask_le_five(value: Column) -> Column:
    """5 or fewer to X, else the nearest 5 as text."""
    return F.when(value <= 5, "X").otherwise((F.round(value / 5) * 5).cast("long").cast("string"))


def map_safe_values(table: DataFrame, total: str, count: str, per: str, stand_in: int = 6) -> DataFrame:
    """Numbers to colour a map with: a masked share is the largest harmless one, a masked count the stand-in."""
    share = percent(F.lit(stand_in), total, None)
    return table.withColumns({
        per: F.when(F.col(per) == "X", F.when(share > 5, 5.0).otherwise(share)).otherwise(number(per)),
        count: F.when(F.col(count) == "X", F.lit(float(stand_in))).otherwise(number(count)),
    })


def mask_average_below(table: DataFrame, columns: Sequence[str], threshold: float = 100) -> DataFrame:
    """Averages under a threshold to X; text that is not a number stays as it is."""
    return table.withColumns({c: F.when(number(c) < threshold, "X").otherwise(F.col(c)) for c in columns})


def published_small_cells(table: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Number of published cells in 1..5 per column: zero after suppression."""
    return table.agg(*[count_if(number(c).between(1, 5)).alias(c) for c in counts])
