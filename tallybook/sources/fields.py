"""Pattern-driven column selection: which header becomes which column, per stage and year."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

SPEC_TYPE = "map<string,map<string,map<string,string>>>"


class AmbiguousPattern(ValueError):
    """A pattern matches several headers."""


def field_filter_spec(text_rows: DataFrame, column: str = "value") -> DataFrame:
    """(stage, year, pattern, name) rows of nested JSON {stage: {year: {pattern: name}}}; names are trimmed."""
    return (
        text_rows.select(F.explode(F.from_json(column, SPEC_TYPE)).alias("stage", "years"))
        .select("stage", F.explode("years").alias("year", "fields"))
        .select("stage", F.col("year").cast("int").alias("year"), F.explode("fields").alias("pattern", "name"))
        .select("stage", "year", F.trim("pattern").alias("pattern"), F.trim("name").alias("name"))
    )


def read_field_spec(spark: SparkSession, path: str) -> DataFrame:
    """The spec of a JSON file (one document)."""
    return field_filter_spec(spark.read.text(path, wholetext=True))


def fields_of(spec: DataFrame, stage: str, year: int) -> list[tuple[str, str]]:
    """(pattern, name) pairs of one stage and year: a few dozen rows of metadata."""
    rows = spec.filter((F.col("stage") == stage) & (F.col("year") == year)).select("pattern", "name").collect()
    return [(r["pattern"], r["name"]) for r in rows]


def match_headers(headers: Sequence[str], fields: Sequence[tuple[str, str]]) -> dict[str, str | None]:
    """New name -> header (None if no header matches); several matching headers are an error."""
    found: dict[str, str | None] = {}
    for pattern, name in fields:
        hits = [h for h in headers if re.search(pattern, h)]
        if len(hits) > 1:
            raise AmbiguousPattern(f"{pattern!r} matches {hits}")
        if hits or name not in found:
            found[name] = hits[0] if hits else None
    return found


def select_by_pattern(
    df: DataFrame, fields: Sequence[tuple[str, str]], types: Mapping[str, str] | None = None
) -> DataFrame:
    """Project and rename by pattern; blanks become null, a missing column a typed null.

    Values that do not fit their declared type become null.
    """
    types = types or {}
    columns = []
    for name, header in match_headers(df.columns, fields).items():
        kind = types.get(name, "string")
        if header is None:
            value = F.lit(None).cast(kind)
        else:
            value = F.nullif(F.trim(F.col(f"`{header}`").cast("string")), F.lit(""))
            value = value if kind == "string" else value.try_cast(kind)
        columns.append(value.alias(name))
    return df.select(*columns)
