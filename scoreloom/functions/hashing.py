"""Reproducible random numbers: the same for a key and a seed on any cluster and in any order of rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_digits(digits: int, *parts: Column) -> Column:
    """The first hexadecimal digits (at most 15) of the MD5 of the colon-joined parts (null as ''), as a long."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits."""
    return hash_digits(13, *parts) / F.lit(2.0**52)


def normal(*parts: Column) -> Column:
    """A standard normal number, from two uniform ones (Box and Muller)."""
    u, v = (uniform(*parts, F.lit(side)) for side in "ab")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.lit(3.141592653589793) * v)
