"""Closed-form statistics as Spark columns. Literals are doubles throughout: decimals would round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normal quantiles as the methods state them.
Z_WILSON = 1.959964
Z_95 = 1.96


def d(x) -> Column:
    """A double column or literal."""
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return d(a) / F.nullif(d(b), F.lit(0.0))


def wilson(share: Column, n: Column, z: float = Z_WILSON) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share over an effective number n, within [0, 1]."""
    share, n, q = d(share), d(n), d(z * z)
    middle, spread = share + q / (2.0 * n), d(z) * F.sqrt(share * (1.0 - share) / n + q / (4.0 * n * n))
    low, high = (middle - spread) / (1.0 + q / n), (middle + spread) / (1.0 + q / n)
    return F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)


def odds_ratio(a: Column, b: Column, c: Column, e: Column) -> tuple[Column, Column, Column]:
    """Odds ratio of a 2 x 2 table and Woolf bounds; for the bounds half is added to all cells if one is zero."""
    a, b, c, e = d(a), d(b), d(c), d(e)
    add = F.when(F.least(a, b, c, e) == 0.0, F.lit(0.5)).otherwise(F.lit(0.0))
    a1, b1, c1, e1 = a + add, b + add, c + add, e + add
    log_or, se = F.log(a1 * e1 / (b1 * c1)), F.sqrt(1.0 / a1 + 1.0 / b1 + 1.0 / c1 + 1.0 / e1)
    return ratio(a * e, b * c), F.exp(log_or - Z_95 * se), F.exp(log_or + Z_95 * se)


def fisher_z(r: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of a correlation."""
    r = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r))
    z, se = F.atanh(r), 1.0 / F.sqrt(d(n) - 3.0)
    return F.tanh(z - Z_95 * se), F.tanh(z + Z_95 * se)


def graded(value: Column, limits: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the band that abs(value) lies in; names has one more entry than limits."""
    out = F.lit(names[-1])
    for limit, name in reversed(list(zip(limits, names, strict=False))):
        out = F.when(F.abs(value) < limit, name).otherwise(out)
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).otherwise(out)


def association_grade(v: Column) -> Column:
    return graded(v, (0.05, 0.10, 0.20, 0.40, 0.80), ("none", "very weak", "weak", "moderate", "strong", "very strong"))


def correlation_grade(r: Column) -> Column:
    return graded(r, (0.20, 0.40, 0.60, 0.90), ("very weak", "weak", "moderate", "strong", "very strong"))


def difference_grade(x: Column) -> Column:
    return graded(x, (0.2, 0.5, 0.8), ("negligible", "small", "medium", "large"))


def eta_grade(x: Column) -> Column:
    return graded(x, (0.01, 0.06, 0.14), ("negligible", "small", "medium", "large"))


def rank_grade(x: Column) -> Column:
    return graded(x, (0.1, 0.3, 0.5), ("negligible", "small", "medium", "large"))


def auc_grade(x: Column) -> Column:
    return graded(x, (0.6, 0.7, 0.8, 0.9), ("none", "poor", "fair", "good", "excellent"))


def p_stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("ns")


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "< 0.001").otherwise(F.format_number(p, 3))


def category_text(c: Column) -> Column:
    """A value as category: whole numbers without decimals."""
    number = c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(c.cast("string"))
