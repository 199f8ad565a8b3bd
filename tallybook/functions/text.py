"""Cleaning of names, postcodes and qualification titles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- Fixed values: the substitutions and keywords of the qualification tables. ---

TYPE_NAMES = {
    "GCSE (A* to G)": "GCSE", "Vocationally-Related Qualification": "Voc", "Functional Skills": "Func skills",
    "Entry Level": "Entry", "Other General Qualification": "Other", "GCE AS Level": "GCE AS", "GCE A Level": "GCE A",
}
LEVEL_STEPS = [("Entry Level", "Entry"), ("Level", "")]
TITLE_STEPS = [
    (r"Information and Communication Technology \(ICT\)", "ICT"),
    ("Information and Communication Technology", "ICT"),
    (r"information and communication technology \(ICT\)", "ICT"),
    ("information and communication technology", "ICT"),
    ("Information Technology", "IT"),
    ("at Level 3", ""), ("at level 3", ""), ("at Level 2", ""), ("at level 2", ""), ("at Level 1", ""),
    ("at level 1", ""), ("Entry Level", ""), ("Level 3", ""), ("Level 1/2", ""), ("Level 1/Level 2", ""),
    ("Level 1", ""), ("Level 2", ""),
]
SHORT_COURSE = {"50085104": "AQA GCSE in ICT (short course)"}
INCLUDE_TITLES = [
    "ICT", "information and communication", "information technology", "IT application skills",
    "information communication", "Computer", "Computing", "Digital", "Office Technology", "iMedia",
    "Handling & Interpreting Data", "D&T Sys & Control", "System & Control", "Systems & Control",
    "Systems and Control", "Keyboarding", "Web", "desktop", "Networking", "Electronic Engineering", "VFX",
    "information and cerative technology", "IT User skills", "Open Systems and Enterprise", " IT ", " IT$",
    "Media", "animation",
]
EXCLUDE_TITLES = ["Fashion"]


def no_spaces(value: Column) -> Column:
    return F.translate(value, " ", "")


def alphanumeric(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def replace_in_order(value: Column, steps) -> Column:
    for pattern, replacement in steps:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def normalise_type(value: Column, names=TYPE_NAMES) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def matches_titles(title: Column, include, exclude=()) -> Column:
    """Any include pattern and no exclude pattern, both case-insensitive."""
    wanted = title.rlike("(?i)" + "|".join(include))
    return wanted & ~title.rlike("(?i)" + "|".join(exclude)) if exclude else wanted
