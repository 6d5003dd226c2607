"""Values that an expression uses several times.

Explodes of costly arrays are `explode_outer` with a filter behind them throughout the library: for a plain one Spark infers
a filter on the array's size, which makes the array a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
