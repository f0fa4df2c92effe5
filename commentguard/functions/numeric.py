"""Decimal rounding of binary doubles, to the nearest, exact ties to even.

Spark's ``round`` works on the shortest decimal form of a double, so it moves
0.6275 up although the stored number lies below the tie.  Scores here follow
the stored number: the error of ``x * 10**digits`` is recovered exactly with
two half-width products, so the comparison with the tie is exact too.
"""

from pyspark.sql import Column, functions as F

_HALF_WIDTH = 134217729.0  # 2**27 + 1 cuts a double into two 26-bit halves


def round_nearest(x: Column, digits: int) -> Column:
    """Round a non-negative double column to ``digits`` decimals.

    ``x`` is read several times; hand in a materialised column, not a large
    expression.
    """
    scale = F.lit(float(10**digits))
    scaled = x * scale
    wide = x * F.lit(_HALF_WIDTH)
    high = wide - (wide - x)
    low = x - high
    error = (high * scale - scaled) + low * scale
    whole = F.floor(scaled).cast("double")
    beyond_tie = (scaled - whole - F.lit(0.5)) + error
    rounded = (
        F.when(beyond_tie > 0, whole + 1)
        .when(beyond_tie < 0, whole)
        .otherwise(whole + F.pmod(whole, F.lit(2.0)))
    )
    return rounded / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as a double, 0 where the denominator is 0."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))
