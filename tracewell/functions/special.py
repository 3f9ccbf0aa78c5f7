"""Special functions as column expressions, for positive arguments: a shift upwards by the recurrence, then the asymptotic series."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8
#: Bernoulli numbers B2, B4, ... of both series.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)


def digamma(x: Column) -> Column:
    y = x + SHIFT
    series = sum((F.lit(-b / (2 * i)) / F.pow(y, F.lit(2 * i)) for i, b in enumerate(BERNOULLI, 1)), F.log(y) - F.lit(0.5) / y)
    return series - sum((F.lit(1.0) / (x + i) for i in range(1, SHIFT)), F.lit(1.0) / x)


def lgamma(x: Column) -> Column:
    y = x + SHIFT
    series = sum((F.lit(b / (2 * i * (2 * i - 1))) / F.pow(y, F.lit(2 * i - 1)) for i, b in enumerate(BERNOULLI, 1)), (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi))
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    return series - F.log(product)
