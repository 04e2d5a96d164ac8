"""Binding: a value that an expression uses often is computed once for a row."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, as the variable of a higher-order function."""
    return F.transform(F.array(value), lambda v: body(v))[0]
