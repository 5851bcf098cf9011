"""Columns that are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, none of whose making is repeated by what follows.

    The optimiser writes the making of a column into every filter over it that it pushes down, and so makes it again for
    each use there; it does not push filters below a generator. So costly columns come from one, over a single struct. The
    struct is made by a projection below it, as only projections compute what several columns share once.
    Columns of ``df`` with these names are replaced.
    """
    kept = [n for n in df.columns if n not in columns]
    kept = [F.col("`" + n.replace("`", "``") + "`") for n in kept]
    made = df.select(*kept, F.struct(*[value.alias(name) for name, value in columns.items()]).alias("__made"))
    return made.select(*kept, F.inline(F.array("__made")))
