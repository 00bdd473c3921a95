"""Name a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used several times inside a lambda is evaluated at every use and for
    every element; a lambda argument is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
