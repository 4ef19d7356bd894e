"""Function names of Python texts that do not parse."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FUNCTION_NAME = r"(?U)def\s+(\w+)\s*\("  # fixed value


def function_names(text: Column) -> Column:
    """Set of names after ``def``, for texts that do not parse."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FUNCTION_NAME), F.lit(1)))
