"""Aggregate functions by name. Each builder takes compiled arguments, already masked by FILTER."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that make a query an aggregate one (fixed values). VARIANCE and STDDEV are the population's.
SIMPLE: dict[str, Callable[[Column], Column]] = {
    "SUM": F.sum,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "VARIANCE": F.var_pop,
    "VAR_POP": F.var_pop,
    "VARIANCE_POP": F.var_pop,
    "VAR_SAMP": F.var_samp,
    "VARIANCE_SAMP": F.var_samp,
    "STDDEV": F.stddev_pop,
    "STDDEV_POP": F.stddev_pop,
    "STDDEV_SAMP": F.stddev_samp,
    "ANY_VALUE": F.any_value,
    "BOOL_AND": F.bool_and,
    "BOOL_OR": F.bool_or,
    "MEDIAN": F.median,
    "APPROX_COUNT_DISTINCT": F.approx_count_distinct,
}
NAMES = {*SIMPLE, "COUNT", "PERCENTILE_CONT", "PERCENTILE_DISC", "APPROX_QUANTILE", "SUMIF", "AVGIF", "COUNTIF"}
NUMERIC = {"SUM", "AVG", "VARIANCE", "VAR_POP", "VARIANCE_POP", "VAR_SAMP", "VARIANCE_SAMP", "STDDEV", "STDDEV_POP", "STDDEV_SAMP"}


def masked(value: Column, condition: Column | None) -> Column:
    """The value where the condition holds, else NULL, which aggregates skip."""
    return value if condition is None else F.when(condition, value)


def percentile_cont(fraction: float, value: Column) -> Column:
    """Exact, linear between the two neighbours."""
    return F.percentile(value.cast("double"), fraction)


def percentile_disc(fraction: Decimal, value: Column, down: bool = False) -> Column:
    """The value at rank ceil(fraction * n), 1 at least, exactly; down: ranks from the largest. Values of a group
    are held together."""
    held = F.sort_array(F.collect_list(value), not down)
    rank = F.ceil(F.size(held).cast("decimal(10,0)") * F.lit(fraction)).cast("int")
    return F.get(held, F.greatest(rank - 1, F.lit(0)))


def quantile_lower(value: Column, fraction: float) -> Column:
    """The value at rank floor(fraction * (n - 1)), exactly. Values of a group are held together, so for very
    large groups quantile_sketch is the bounded form."""
    held = F.sort_array(F.collect_list(value))
    return F.get(held, F.floor((F.size(held) - 1) * F.lit(fraction)).cast("int"))


def quantile_sketch(value: Column, fraction: float, accuracy: int = 10_000) -> Column:
    """Approximate quantile in bounded memory; rank error at most 1/accuracy."""
    return F.percentile_approx(value, fraction, accuracy)
