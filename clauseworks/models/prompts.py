"""Prompt templates: named fields, and an error for a missing one."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def render(template: str, **values: object) -> str:
    """The template with its fields filled in; a field without a value is a KeyError."""
    return template.format(**values)


def rendered(template: str, **columns: Column) -> Column:
    """The same as an expression, a row at a time inside the JVM; null values are empty."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def shortened(text: Column, longest: int) -> Column:
    """The first characters of a text, as a judge sees it."""
    return F.substring(text, 1, longest)
