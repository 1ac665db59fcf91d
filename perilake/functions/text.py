"""Sentences rendered from grouped rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

UNKNOWN = "unknown"


def show(name: str, fmt: str = "%s") -> Column:
    """One formatted value; a missing value reads as 'unknown'."""
    col = F.col(name)
    return F.when(col.isNull(), UNKNOWN).otherwise(F.format_string(fmt, col))


def render(template: str, formats: Mapping[str, str]) -> Column:
    """Fill ``{column}`` slots of the template with formatted columns."""
    parts = []
    for i, piece in enumerate(template.replace("}", "{").split("{")):
        if i % 2:
            parts.append(show(piece, formats.get(piece, "%s")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
