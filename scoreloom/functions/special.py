"""Distribution functions that Spark SQL lacks, as column expressions.

They rest on the regularised incomplete gamma functions: below the mean the lower one by its power
series, above it the upper one by its continued fraction, both with their factor in logarithms. So
tails keep their digits, and large degrees of freedom neither overflow nor are cut off. They are meant
for the few rows of a result.
"""

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """ln of gamma(z) for z > 0: Stirling's series at z + 10, and back by the recurrence."""
    w = z + 10
    v = 1 / (w * w)
    series = (w - 0.5) * F.log(w) - w + 0.9189385332046727 + (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v * (1 / 1680 - v / 1188)))) / w
    product = z
    for k in range(1, 10):
        product = product * (z + k)
    return F.when(z < 1e6, series - F.log(product)).otherwise((z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z))


def _tail(x: Column, df: Column, upper: bool) -> Column:
    a, h = df.cast("double") / 2, F.greatest(x.cast("double") / 2, F.lit(_TINY))
    factor = F.exp(a * F.log(h) - h - log_gamma(a))
    # both converge within some square roots of a
    steps = F.sequence(F.lit(1), F.ceil(100 + 12 * F.sqrt(F.greatest(a, F.lit(1.0)))).cast("int"))
    series = F.aggregate(
        steps,
        F.struct((1 / a).alias("term"), (1 / a).alias("total")),
        lambda s, k: F.struct((s["term"] * h / (a + k)).alias("term"), (s["total"] + s["term"] * h / (a + k)).alias("total")),
        lambda s: s["total"] * factor,
    )
    away = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)
    b0 = h + 1 - a

    def lentz(s: Column, k: Column) -> Column:
        an, b = -k * (k - a), s["b"] + 2
        d, c = 1 / away(an * s["d"] + b), away(b + an / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["f"] * d * c).alias("f"))

    first = 1 / away(b0)
    fraction = F.aggregate(steps, F.struct(b0.alias("b"), F.lit(1 / _TINY).alias("c"), first.alias("d"), first.alias("f")), lentz, lambda s: s["f"] * factor)
    low = h < a + 1
    q = F.when(low, 1 - series).otherwise(fraction) if upper else F.when(low, series).otherwise(1 - fraction)
    at_zero = 1.0 if upper else 0.0
    return F.when(x.isNull() | df.isNull() | (df < 1), F.lit(None).cast("double")).when(x <= 0, at_zero).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))


def chi2_cdf(x: Column, df: Column) -> Column:
    """Chi-square distribution function; null for null input or df below 1."""
    return _tail(x, df, upper=False)


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X >= x), also where it is very small."""
    return _tail(x, df, upper=True)


def normal_cdf(z: Column) -> Column:
    tail = normal_two_sided(z) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""
    return chi2_sf(z * z, F.lit(1))


def normal_quantile(p: float) -> float:
    """A constant of the plan."""
    return NormalDist().inv_cdf(p)
