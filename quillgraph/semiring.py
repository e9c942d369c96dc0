"""Semirings as pairs of column expressions: how an entry meets a vector's value, and how a row's products add up.

A product of null contributes nothing; ``zero`` is what a row without contributions gets, where a domain is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    mul: Callable[[Column, Column], Column]
    add: Callable[[Column], Column]
    zero: object = None


PLUS_TIMES = Semiring(lambda a, x: a * x, F.sum, 0.0)
#: Only the negative entries of a Laplacian, which are those off its diagonal.
OFF_DIAGONAL = Semiring(lambda a, x: F.when(a < 0, a * x), F.sum, 0.0)
DIAGONAL = Semiring(lambda a, x: F.when(a > 0, a * x), F.sum, 0.0)
INVERSE_DIAGONAL = Semiring(lambda a, x: F.when(a > 0, F.try_divide(x, a)), F.sum, 0.0)
MAX = Semiring(lambda a, x: x, F.max)
MIN_INDEX = Semiring(lambda a, x: F.when(a != 0, x), F.min)
SELECT_RIGHT = Semiring(lambda a, x: x, F.max, -1)
COLLECT = Semiring(lambda a, x: x, lambda x: F.sort_array(F.collect_list(x)))
COUNT_NONZERO = Semiring(lambda a, x: (a != 0).cast("long"), F.sum, 0)
