"""Columns by name, whatever characters the name has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name; a dot in it doesn't reach into a struct."""
    return F.col("`" + name.replace("`", "``") + "`")
