"""Measures of itemsets as expressions over their occurrences (u, p, rem)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of all comparisons.
EPSILON = 1e-10


def utility(profit: Column | str = "profit", quantity: Column | str = "quantity") -> Column:
    return F.col(profit) * F.col(quantity) if isinstance(profit, str) else profit * quantity


def positive(u: Column) -> Column:
    return F.greatest(u, F.lit(0.0))


def expected_utility() -> Column:
    return F.sum(F.col("u") * F.col("p"))


def existential_probability() -> Column:
    """1 - product(1 - p): a product has no trouble with certain items."""
    return F.lit(1.0) - F.product(F.lit(1.0) - F.col("p"))


def existential_probability_log() -> Column:
    """The same by logarithms, exact for tiny p: certain occurrences are told apart first."""
    certain = F.max(F.col("p") >= 1.0)
    return F.when(certain, F.lit(1.0)).otherwise(-F.expm1(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - 1e-16))))))


def upper_bound() -> Column:
    """No itemset that only adds items of later ranks has a larger expected utility.

    Each occurrence is bounded on its own by what the items after it could still add, and by zero.
    """
    return F.sum(F.greatest(F.col("u") + F.col("rem"), F.lit(0.0)) * F.col("p"))


def qualifies(min_pro: float, threshold: float) -> Column:
    return (F.col("ep") >= min_pro - EPSILON) & (F.col("eu") >= threshold - EPSILON)
