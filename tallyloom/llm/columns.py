"""Columns by their exact names, whatever characters these have, and names that a table does not use yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def named(name: str) -> Column:
    """The column of this very name; dots in it are no paths."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has that name."""
    taken = {n.lower() for n in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with the column ``old`` called ``new``."""
    return df.select(*[named(n).alias(new if n == old else n) for n in df.columns])
