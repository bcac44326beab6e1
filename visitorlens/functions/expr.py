"""Small expression builders shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A plain Python variable would repeat the expression at every use, and the
    optimizer may inline a projected column into a lambda, where it would be
    recomputed for every array element. A lambda variable is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
