"""Grade scales, code labels and provider classes as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# --- Fixed values: they must equal the published scales and code lists. ---

# GCSE letter -> points on the 0-8 scale, and on the older 16-58 scale.
GCSE_POINTS = {"U": 0, "G": 1, "F": 2, "E": 3, "D": 4, "C": 5, "B": 6, "A": 7, "*": 8}
GCSE_OLD_POINTS = {"U": 0, "G": 16, "F": 22, "E": 28, "D": 34, "C": 40, "B": 46, "A": 52, "*": 58}
# A-level letter -> points, and the older tariff.
ALEVEL_POINTS = {"U": 0, "E": 150, "D": 180, "C": 210, "B": 240, "A": 270, "*": 300}
TARIFF_POINTS = {"U": 0, "E": 20, "D": 30, "C": 40, "B": 50, "A": 60, "*": 70}
LETTER_POINTS = {"GCSE": GCSE_POINTS, "Alevel": ALEVEL_POINTS, "tariff": TARIFF_POINTS}

# 2017 reform: points of unreformed subjects -> the 0-8 scale; reformed subjects keep theirs.
REFORM_POINTS = {8.5: 8.0, 7.0: 7.0, 5.5: 6.0, 4.0: 5.0, 3.0: 4.0, 2.0: 3.0, 1.5: 2.0, 1.0: 1.0}
REFORMED_SUBJECTS = ["2210", "5030", "5110"]

# Average grade above a bound -> label.
AVERAGE_BANDS = [
    (7.5, "A*"), (7.0, "A"), (6.5, "A-"), (6.0, "B*"), (5.5, "B-"), (5.0, "C"), (4.5, "C-"), (4.0, "D"),
    (3.5, "D-"), (3.0, "E"), (2.5, "E-"), (2.0, "F"), (1.5, "F-"), (1.0, "G"), (0.0, "U"),
]

ETHNICITY_MAJOR = {
    "": "Missing", "AOEG": "Other", "ASIA": "Asian", "CHIN": "Chinese", "MIXD": "Mixed", "UNCL": "Undeclared",
    "WHIT": "White", "BLAC": "Black", "WHIBRI": "White British", "WHIOTH": "White Other",
}
ETHNICITY_MINOR = {
    "": "Missing", "ABAN": "Bangladeshi", "AIND": "Indian", "APKN": "Pakistani", "AOTH": "Asian Other",
    "BAFR": "Black African", "BCRB": "Black Caribbean", "BOTH": "Black Other", "CHNE": "Chinese",
    "MOTH": "Mixed Other", "MWAS": "Mixed White Asian", "MWBA": "Mixed White Black African",
    "MWBC": "Mixed White Black Caribbean", "WBRI": "White British", "WIRI": "White Irish",
    "WIRT": "White Irish Traveller", "WOTH": "White Other", "WROM": "White Romani", "REFU": "Refused",
    "OOTH": "Other", "NOBT": "Not obtained",
}
SEN_LABELS = {
    "N": "None", "A": "School action", "P": "School action plus", "S": "Statement", "E": "EHC plan",
    "K": "SEN support",
}
EAL_LABELS = {"1": "English", "2": "English Additional Language", "3": "Unclassified"}

# Region name -> code.
REGION_CODES = {
    "North East": "42353", "North West": "121915", "London": "117537", "West Midlands": "59646",
    "Yorkshire and The Humber": "60802", "South West": "122188", "East Midlands": "52650", "South East": "51776",
    "East of England": "40935",
}

# Significance level below which a mark applies.
STAR_LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, ".")]

# Identifiers from here on do not belong to real providers.
FIRST_INVALID_PROVIDER = 900000


def lookup(column: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed table; ``default`` (else null) where the key is absent."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    found = F.try_element_at(pairs, column)
    return found if default is None else F.coalesce(found, default)


def points_to_letter(points: Column, level: str = "GCSE") -> Column:
    tables = [GCSE_POINTS, GCSE_OLD_POINTS] if level == "GCSE" else [LETTER_POINTS[level]]
    letters = {float(p): letter for table in tables for letter, p in table.items()}
    return lookup(points.cast("double"), letters)


def letter_to_points(letter: Column, level: str = "GCSE") -> Column:
    return lookup(letter, {k: float(v) for k, v in LETTER_POINTS[level].items()})


def rescale_points(points: Column, subject: Column, reformed=tuple(REFORMED_SUBJECTS)) -> Column:
    return F.when(subject.isin(*reformed), points).otherwise(lookup(points, REFORM_POINTS, points))


def average_to_band(average: Column) -> Column:
    """Label of an average grade; X for anything not above zero, including null."""
    label = None
    for bound, name in AVERAGE_BANDS:
        label = F.when(average > bound, name) if label is None else label.when(average > bound, name)
    return label.otherwise("X")


def decode(code: Column, table: dict, unknown: str) -> Column:
    """Name of a code; unknown codes and null give ``unknown``."""
    return lookup(code.cast("string"), table, F.lit(unknown))


def provider_class(sch_type: Column, selective: Column) -> Column:
    """Special / Independent / Grammar / Comprehensive."""
    return (
        F.when(sch_type.contains("special"), "Special")
        .when(sch_type.contains("inde"), "Independent")
        .when(F.coalesce(selective, F.lit("")).contains("Selective"), "Grammar")
        .otherwise("Comprehensive")
    )


def provider_class_3(
    sch_type: Column, selective: Column, marker: str = "inde", names=("Independent", "Grammar school", "State non-selective")
) -> Column:
    """Three-way class; the marker and the labels differ between reports."""
    return (
        F.when(sch_type.contains(marker), names[0])
        .when(F.coalesce(selective, F.lit("")).contains("Selective"), names[1])
        .otherwise(names[2])
    )


def urban_class(label: Column) -> Column:
    return F.when(label.contains("Rural"), "Rural").when(label.isNotNull(), "Urban")


def stars(p: Column, blank: str = " ") -> Column:
    """Significance marks padded to width three."""
    marks = None
    for level, mark in STAR_LEVELS:
        padded = mark + blank * (3 - len(mark))
        marks = F.when(p < level, padded) if marks is None else marks.when(p < level, padded)
    return marks.when(p.isNotNull(), blank * 3)


def starred(value: Column, p: Column, digits: int = 3, blank: str = " ") -> Column:
    """Number with fixed decimals followed by its marks."""
    return F.concat(F.format_string(f"%.{digits}f", F.round(value, digits)), stars(p, blank))


# --- Fixed values: names of the computing subjects. ---
COMPUTING_SUBJECTS = [
    "Office Technology", "Computer Appreciation / Introduction", "ICT", "Computing", "D&T Sys & Control",
    "Handling & Interpreting Data", "Applied ICT", "Music Technology (Electronic)", "Computer Architecture / Systems",
    "Keyboarding", "Applications", "WebSite Development", "Computer help", "desk Operations",
    "Systems / Network Management", "Computer Games", "Electronic / Electrical Engineering",
]
