"""Scalar functions whose meaning differs from the built-in of the same name. All are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    """Division of doubles: x/0 is an infinity whose sign is that of both, 0/0 and NaN/0 are NaN, never an error."""
    a, b = a.cast("double"), b.cast("double")
    # The power of -1 of a zero is the infinity of its sign.
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; NULL for a divisor of 0."""
    return F.try_mod(a, b)


def round_away(x: Column, digits: Column | int = 0) -> Column:
    """Half away from zero in binary arithmetic; digits within 18."""
    x = x.cast("double")
    if isinstance(digits, int):
        scale = F.lit(10.0 ** max(-18, min(18, digits)))
    else:
        scale = F.pow(F.lit(10.0), F.greatest(F.lit(-18), F.least(F.lit(18), digits)))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def ceil(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def ln(x: Column) -> Column:
    """Natural logarithm; minus infinity at 0 and NaN below."""
    x = x.cast("double")
    return F.when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)).otherwise(F.ln(x))


def log10(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)).otherwise(F.log10(x))


def log_base(base: Column, x: Column) -> Column:
    return divide(ln(x), ln(base))


def width_bucket(v: Column, low: Column, high: Column, count: Column) -> Column:
    """0 below, count + 1 above, and count at the upper bound itself."""
    inside = F.width_bucket(v.cast("double"), low.cast("double"), high.cast("double"), count.cast("int")).cast("long")
    return F.when(v.cast("double") == high.cast("double"), count.cast("long")).otherwise(inside)


def bucket_micros(at: Column, width: int, origin: int = 0) -> Column:
    """Start of the bucket that holds a timestamp without zone; width and origin in microseconds."""
    micros = F.unix_micros(at.cast("timestamp")) - origin
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)) + origin).cast("timestamp_ntz")


def bucket_number(v: Column, width: float, origin: Column) -> Column:
    """The same over plain numbers, which count as seconds; from 1e12 on, and down from -1e12, they and the origin
    are microseconds. The result has the number's unit."""
    v, origin = v.cast("double"), F.coalesce(origin.cast("double"), F.lit(0.0))
    seconds = F.when(F.abs(origin) >= 1e12, origin / 1_000_000).otherwise(origin)
    start = lambda x, w, o: F.floor((x - o) / w).cast("double") * w + o
    return F.when(F.abs(v) >= 1e12, start(v, width * 1_000_000, seconds * 1_000_000)).otherwise(start(v, width, seconds))


def truncate_time(unit: str, at: Column) -> Column:
    """Start of the unit (weeks begin on Monday), without zone."""
    return F.date_trunc(unit, at).cast("timestamp_ntz")
