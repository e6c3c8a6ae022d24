"""Distribution functions that Spark lacks: of Student's t as a vectorized function for tables of one
row a series, of the normal distribution as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting the argument above 10."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(z) + b * np.log1p(-z)) / a
    c = np.ones_like(z)
    d = 1 - (a + b) * z / (a + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for numerator in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = 1 + numerator / np.where(abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(abs(c * d - 1) < 1e-15):
            break
    value = np.where(inside, front * h, np.where(x <= 0, 0.0, 1.0))
    return np.where(flip, 1 - value, value)


def student_t_p(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Two-sided p value; 0 for an infinite t, NaN where an argument is missing."""
    finite = np.isfinite(t) & (freedom > 0)
    tt, v = np.where(finite, t, 1.0), np.where(finite, freedom, 1.0)
    p = incomplete_beta(v / 2, np.full_like(v, 0.5), v / (v + tt * tt))
    return np.where(finite, p, np.where(np.isinf(t) & (freedom > 0), 0.0, np.nan))


@pandas_udf(DoubleType())
def _student_t_p(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series(student_t_p(t.to_numpy(float), freedom.to_numpy(float)), index=t.index)


#: Coefficients of Wichura's algorithm AS 241 (PPND16), numerators and denominators.
AS241 = (
    ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
     (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)),
    ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """The polynomial with these coefficients, the constant first."""
    return reduce(lambda sum_, c: sum_ * x + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def with_inverse_normal(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adds the quantile of the standard normal distribution at a column of probabilities (AS 241)."""
    ratio = lambda k, x: polynomial(AS241[k][0], x) / polynomial(AS241[k][1], x)
    q, c, r = F.col("_q"), F.col("_c"), F.col("_r")
    parts = df.withColumns({"_q": F.col(p) - 0.5, "_r": F.sqrt(-F.log(F.least(F.col(p), 1 - F.col(p))))}).withColumn("_c", 0.180625 - q * q)
    tail = F.signum(q) * F.when(r <= 5, ratio(1, r - 1.6)).otherwise(ratio(2, r - 5))
    return parts.withColumn(name, F.when(F.abs(q) <= 0.425, q * ratio(0, c)).otherwise(tail)).drop("_q", "_c", "_r")


def t_test(mean: Column, sd: Column, n: Column, popmean: float = 0.0) -> tuple[Column, Column]:
    """t and its two-sided p of a mean; null below two values, or if sd is 0 and the mean fits.

    With sd 0 and another mean, t is infinite and p is 0.
    """
    off = mean - F.lit(float(popmean))
    spread = sd / F.sqrt(n)
    t = F.when(n >= 2, F.when(spread > 0, F.try_divide(off, spread)).when(off > 0, F.lit(float("inf"))).when(off < 0, F.lit(float("-inf"))))
    p = _student_t_p(t, (n - 1).cast("double"))
    return t, F.when(t.isNotNull() & ~F.isnan(p), p)
