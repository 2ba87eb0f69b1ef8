"""Year expressions (P1-P3). All native, so they stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLEAN_YEAR, CLEAN_YEAR_DEFAULT, EXACT_YEAR, YEAR_IN_TEXT


def is_exact_year(c: Column) -> Column:
    """The whole value is four digits (NULL is not)."""
    return c.rlike(EXACT_YEAR)


def year_in_text(text: Column, default: str) -> Column:
    """First stand-alone 19xx/20xx year in free text, else ``default``."""
    y = F.regexp_extract(text, YEAR_IN_TEXT, 1)
    return F.when(y.isNull() | (y == ""), F.lit(default)).otherwise(y)


def clean_year(date_pub: Column) -> Column:
    """First ``20xx`` anywhere in the value (no word boundary), else 2024; NULL gives 2024."""
    y = F.regexp_extract(date_pub, CLEAN_YEAR, 0)
    return F.coalesce(F.nullif(y, F.lit("")), F.lit(str(CLEAN_YEAR_DEFAULT))).cast("int")
