"""Evaluate a value once per row and use it many times inside array functions.

The optimizer may move a column's expression into a lambda that reads it, and would
then compute it once per element. A lambda variable cannot be moved.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))
