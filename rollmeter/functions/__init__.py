"""Column expressions; everything here runs inside Spark's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row.

    The optimizer copies an expression to each place that uses it, also into
    the lambda of a loop over an array; a lambda's own variable is not copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
