"""Rounding, exact sums and ratios that do not depend on partition order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MONEY_SCALE = 4
PART = 1_000_000
BEYOND = 1e24


def round_to(col: Column, digits: int = 0) -> Column:
    """SQL ROUND on the binary value: 1.005 to 2 digits is 1.0, not 1.01.

    Halves go away from zero. F.round would take every value through a decimal,
    which costs more than the rest of a gold row.
    """
    factor = F.lit(float(10**digits))
    scaled = col.cast("double") * factor if digits else col.cast("double")
    near = F.rint(scaled)
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return whole / factor if digits else whole


def to_whole(col: Column) -> Column:
    """Cast to INT as SQL engines do it: to the nearest, halves to even."""
    return F.rint(col.cast("double")).cast("int")


def largest(scale: int) -> float:
    """Largest value that fits 64 bits as a whole number of its last kept digit."""
    return 9.2e18 / 10**scale


def big_sum(col: Column, scale: int = MONEY_SCALE) -> Column:
    """Order-independent sum, as a decimal, of the values beyond ``fixed_sum`` and below 1e24."""
    value = col.cast("double")
    size = F.abs(value)
    return F.sum(F.when((size > largest(scale)) & (size < BEYOND), value).cast(T.DecimalType(38, scale)))


def far_sum(col: Column) -> Column:
    """Sum of the values from 1e24 on, infinities and NaN; its last digits depend on the order."""
    value = col.cast("double")
    return F.sum(F.when(~(F.abs(value) < BEYOND), value))


def joined_sum(*sums: Column) -> Column:
    """The whole of several sums as a double; missing only if all of them are."""
    total = sum((F.coalesce(s.cast("double"), F.lit(0.0)) for s in sums[1:]), F.coalesce(sums[0].cast("double"), F.lit(0.0)))
    return F.when(F.coalesce(*[s.cast("double") for s in sums]).isNotNull(), total)


def fixed_sum(col: Column, scale: int = MONEY_SCALE) -> Column:
    """Order-independent sum as DECIMAL(38, scale).

    Values become whole numbers of the last kept digit, exact up to 2^53 of them
    (9e11 at four places), and are summed in two 64-bit parts. That stays in
    generated code, about nine times faster than summing decimals, and the parts
    only overflow at totals above 9e24 of the last digit. Values beyond that range
    are left to ``big_sum`` and ``far_sum``.
    """
    value = col.cast("double")
    units = F.rint(F.when(F.abs(value) <= largest(scale), value) * F.lit(float(10**scale))).cast("bigint")
    low = units % PART
    high = F.rint((units - low) / PART).cast("bigint")
    whole = T.DecimalType(20, 0)
    total = F.sum(high).cast(whole) * F.lit(PART).cast(T.DecimalType(7, 0)) + F.sum(low).cast(whole)
    total = total.cast(T.DecimalType(27, 0))
    if scale:
        total = total * F.lit(f"1e-{scale}").cast(T.DecimalType(scale, scale))
    return total.cast(T.DecimalType(38, scale))


def exact_sum(col: Column, scale: int = MONEY_SCALE) -> Column:
    """Sum as a double; no value of any size stops it."""
    return joined_sum(fixed_sum(col, scale), big_sum(col, scale), far_sum(col))


def exact_avg(col: Column, scale: int = MONEY_SCALE) -> Column:
    return F.try_divide(exact_sum(col, scale), F.count(col).cast("double"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return round_to(ratio * F.lit(100.0), digits)


def safe_ratio(num: Column, den: Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """Ratio that is NULL on a zero divisor, optionally scaled and rounded."""
    ratio = F.try_divide(num.cast("double"), den.cast("double"))
    if scale != 1.0:
        ratio = ratio * F.lit(float(scale))
    return ratio if digits is None else round_to(ratio, digits)
