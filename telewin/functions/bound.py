"""Naming the value of an expression, so that it is worked out once."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it.

    Written out instead, a parsed text or a hash would be worked out wherever it is named: Spark shares
    equal parts of an expression neither inside lambdas nor across the branches of a condition.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))
