"""Interpretation labels: thresholds as data, and one builder of their CASE expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (exclusive upper bound, label) in ascending order, then the label of all above.
IV = ([(0.02, "Not predictive"), (0.1, "Weak"), (0.3, "Medium"), (0.5, "Strong")], "Suspicious (possible overfitting)")
PSI = ([(0.10, "No significant change"), (0.25, "Moderate change")], "Significant change")
GINI = ([(0.20, "Poor"), (0.40, "Acceptable"), (0.60, "Good"), (0.80, "Very good")], "Excellent (verify overfitting)")
#: Fixed values with inclusive upper bounds.
GINI_THREE = ([(0.30, "Poor"), (0.50, "Acceptable")], "Strong")
R_SQUARED = ([(0.1, "Acceptable"), (0.2, "Good")], "Excellent")


def label(value: Column, table: tuple[list[tuple[float, str]], str], inclusive: bool = False) -> Column:
    """The label of the first bound that ``value`` is below (or at, if inclusive); null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in table[0]:
        out = out.when((value <= bound) if inclusive else (value < bound), name)
    return out.otherwise(table[1])
