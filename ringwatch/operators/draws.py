"""Binomial draws by inverting the distribution: one row a draw, however many trials it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts further than this many standard deviations from the mean (and ten more) have less probability than a draw's uniform number can tell.
REACH = 9


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series from x + 8 on, to about 1e-13."""
    y = x + 8.0
    series = (y + 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x + 1.0
    for i in range(2, 9):
        product = product * (x + float(i))
    return series - F.log(product)


def with_distribution(df: DataFrame, n: str, p: str) -> DataFrame:
    """``df`` with ``low``, the least count of Binomial(n, p) worth telling, and ``upto``, the distribution function from there on.

    The arrays have some twenty standard deviations' length, so they grow as the square root of n.
    """
    size, share = F.col(n).cast("double"), F.col(p).cast("double")
    mean, spread = size * share, F.sqrt(size * share * (1 - share))
    sure = (share <= 0) | (share >= 1)
    df = df.withColumn("low", F.when(sure, F.round(mean)).otherwise(F.greatest(F.lit(0.0), F.floor(mean - REACH * spread - 10))).cast("long"))
    high = F.when(sure, F.round(mean)).otherwise(F.least(size, F.ceil(mean + REACH * spread + 10))).cast("long")
    chance = lambda j: F.when(sure, 1.0).otherwise(F.exp(log_factorial(size) - log_factorial(j) - log_factorial(size - j) + j * F.log(share) + (size - j) * F.log(1 - share)))
    df = df.withColumn("_chance", F.transform(F.sequence("low", high), lambda j: chance(j.cast("double"))))
    total = lambda x, i: F.aggregate(F.slice("_chance", 1, i + 1), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("upto", F.transform("_chance", total)).drop("_chance")


def inverted(u: Column) -> Column:
    """The count at the uniform number ``u`` of the row's distribution."""
    return F.least(F.col("low") + F.size(F.filter("upto", lambda c: c <= u)), F.col("low") + F.size("upto") - 1)
