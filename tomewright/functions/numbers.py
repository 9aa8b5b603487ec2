"""Rule numbers: section, parent, order, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a rule number (section, rule, letter), and where malformed ones sort.
NUMBER = r"^(\d{3})(?:\.(\d+)([a-z])?)?$"
LAST = 999


def parent_of(number: Column) -> Column:
    """The rule a sub-rule belongs to; any other number is its own parent."""
    return F.regexp_replace(number, r"^(\d{3}\.\d+)[a-z]$", "$1")


def section_of(number: Column) -> Column:
    return F.substring(number, 1, 3)


def sort_key(number: Column) -> Column:
    """Struct that sorts numbers as numbers (702.2 before 702.10); malformed ones come last, by text."""
    part = lambda i: F.nullif(F.regexp_extract(number, NUMBER, i), F.lit(""))
    good = number.rlike(NUMBER)
    as_int = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    return F.struct(
        F.when(good, as_int(part(1))).otherwise(LAST).alias("section"),
        F.when(good, as_int(part(2))).otherwise(LAST).alias("sub"),
        F.when(good, F.coalesce(part(3), F.lit(""))).otherwise(number).alias("letter"),
    )


def matches_prefix(number: Column, prefix: Column) -> Column:
    """``number`` is ``prefix`` or lies under it: a section's rules, a rule's sub-rules; 702.90 is not under 702.9."""
    under_section = ~F.contains(prefix, F.lit(".")) & F.startswith(number, F.concat(prefix, F.lit(".")))
    under_rule = prefix.rlike(r"\.\d+$") & F.startswith(number, prefix) & F.substr(number, F.length(prefix) + 1).rlike("^[a-z]$")
    return (number == prefix) | under_section | under_rule


def number_query(text: Column) -> Column:
    """The number a query consists of, null for any other query. ``text`` is normalised."""
    pattern = r"^\s*(\d{3}(?:\.\d+[a-z]?)?)\.?\s*$"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
