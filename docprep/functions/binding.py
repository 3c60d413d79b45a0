"""Work out a value once inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once however often it is used.

    Spark folds neighbouring projections together, so a costly column named in
    an inner function would be worked out for every array element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
