"""String expressions over article fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MIN_ABSTRACT_CHARS, MIN_AUTHOR_CHARS, MISSING_ABSTRACT, TRAILING_COUNTRY

# --- fixed values: strings pandas' read_csv reads as missing by default -----
# The dashboard reads the fact back from CSV, so these author strings vanish
# before its author split; the BI operators reproduce that.
CSV_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def csv_null(c: Column) -> Column:
    """NULL where a CSV round trip through pandas would give a missing value."""
    return F.when(c.isin(CSV_NA_STRINGS), F.lit(None).cast("string")).otherwise(c)


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_valid_text(c: Column) -> Column:
    """Not NULL, not the ``N/A`` placeholder, longer than 20 characters."""
    return c.isNotNull() & (c != MISSING_ABSTRACT) & (F.length(c) > MIN_ABSTRACT_CHARS)


def raw_author_parts(authors: Column) -> Column:
    """Split at commas, no trimming (the Spark analysis stage)."""
    return F.split(authors, ",")


def trimmed_author_parts(authors: Column) -> Column:
    """Split at commas and strip each part (the dashboard), missing lists dropped."""
    return F.transform(F.split(csv_null(authors), ","), strip_ws)


def graph_author_parts(authors: Column) -> Column:
    """Parts longer than two characters, tested before stripping, then stripped."""
    parts = F.filter(F.split(csv_null(authors), ","), lambda x: F.length(x) > MIN_AUTHOR_CHARS)
    return F.transform(parts, strip_ws)


def trailing_country(affiliations: Column) -> Column:
    """One-word country after the last ``", "``; ``''`` when there is none."""
    return F.regexp_extract(affiliations, TRAILING_COUNTRY, 1)
