"""The normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series, which are all positive: enough for both tails of 8 deviations to the last digits of a double.
TERMS = 160


def erf(x: Column) -> Column:
    """The error function of x >= 0: 2/sqrt(pi) exp(-x^2) times the sum of 2^n x^(2n+1) / (1 3 5 ... (2n+1)); 1 from 6 on."""
    small = F.least(x, F.lit(6.0))
    # a term is the one before it times 2x^2 / (2n+1)
    added = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), F.struct(small.alias("term"), small.alias("sum")),
        lambda acc, n: F.struct((acc["term"] * 2 * small * small / (2 * n + 1)).alias("term"), (acc["sum"] + acc["term"] * 2 * small * small / (2 * n + 1)).alias("sum")),
    )
    return F.when(x >= 6.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 / math.sqrt(math.pi) * F.exp(-small * small) * added["sum"]))


def two_sided_p(z: Column) -> Column:
    """The probability of a standard normal value at least as far from 0 as z."""
    return F.lit(1.0) - erf(F.abs(z) / math.sqrt(2))
