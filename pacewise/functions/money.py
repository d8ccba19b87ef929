"""Sums of amounts that do not depend on the order of addition.

Doubles added in another order differ in the last bit, and Spark fixes no order.
Amounts are therefore added as whole minor units and divided once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minor_units(amount: Column, decimals: int = 2) -> Column:
    """Whole minor units; an amount that is not whole in them fails the query, and is never rounded away."""
    scaled = amount * float(10 ** decimals)
    whole = F.abs(scaled - F.rint(scaled)) <= F.lit(1e-6) + F.abs(scaled) * F.lit(1e-13)
    message = F.concat(F.lit("amount is not whole in minor units: "), amount.cast("string"))
    return F.when(amount.isNull() | whole, F.rint(scaled).cast("long")).otherwise(F.raise_error(message).cast("long"))


def from_minor_units(units: Column, decimals: int = 2) -> Column:
    return units.cast("double") / float(10 ** decimals)


def exact_sum(amount: Column, decimals: int = 2) -> Column:
    """Sum of amounts as a double, the same for every partitioning."""
    return from_minor_units(F.sum(minor_units(amount, decimals)), decimals)
