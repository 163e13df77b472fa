"""Rounding rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column) -> Column:
    """Nearest whole number, ties to even (double)."""
    return F.rint(c)


def round_scaled(c: Column, digits: int) -> Column:
    """NumPy's decimal rounding: scale, round half-even, scale back."""
    p = float(10**digits)
    return F.rint(c * F.lit(p)) / F.lit(p)


def let(c: Column, use) -> Column:
    """``use`` applied to a value that is computed once, however often it appears there."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def round_exact(c: Column, digits: int) -> Column:
    """Python's ``round(x, digits)``: the tie is judged on the exact binary value.

    The product ``x * 10**digits`` is split without error into its rounded
    value and a remainder (Dekker's product); the remainder settles the cases
    where the rounded product ends in exactly one half.
    """
    p = F.lit(float(10**digits))

    def rounded(x: Column) -> Column:
        product = x * p
        widened = x * F.lit(134217729.0)
        high = widened - (widened - x)
        remainder = (high * p - product) + (x - high) * p
        return let(F.struct(product.alias("product"), remainder.alias("rest")), settled)

    def settled(s: Column) -> Column:
        floor = F.floor(s["product"]).cast("double")
        tie = (s["product"] - floor) == F.lit(0.5)
        whole = (
            F.when(tie & (s["rest"] > 0), floor + 1)
            .when(tie & (s["rest"] < 0), floor)
            .otherwise(F.rint(s["product"]))
        )
        return whole / p

    return let(c, rounded)
