"""RANGE frames that slide, in time in proportion to the rows. Spark adds up each row's frame anew, in one task a partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import aggregates as AGG
from quillon.plans import ast as A
from quillon.plans.expressions import Compiler, walk

#: Aggregates of a whole that follow from those of two parts; the others are left to Spark.
_SPREAD = {"VARIANCE", "VAR_POP", "VARIANCE_POP", "VAR_SAMP", "VARIANCE_SAMP", "STDDEV", "STDDEV_POP", "STDDEV_SAMP"}
MERGED = {"SUM", "SUMIF", "AVG", "AVGIF", "COUNT", "COUNTIF", "MIN", "MAX", "BOOL_AND", "BOOL_OR"} | _SPREAD


def slide(df: DataFrame, compiler: Compiler, used: list[A.Expr]) -> tuple[DataFrame, dict[A.Expr, Column]]:
    """The frame with the results of its sliding windows, and the columns that hold them."""
    calls = dict.fromkeys(e for u in used for e in walk(u) if isinstance(e, A.Call) and e.over is not None and e not in compiler.known)
    groups: dict[A.Over, tuple[Column, int, int, list[A.Call]]] = {}
    for e in calls:
        found = reach(compiler, e)
        if found is not None:
            groups.setdefault(e.over, (*found, []))[3].append(e)
    known: dict[A.Expr, Column] = {}
    for over, (key, low, high, members) in groups.items():
        names = {e: f"__slide_{len(known) + n}" for n, e in enumerate(members)}
        df = _cells(df, compiler, over, key, low, high, names)
        known |= {e: F.col(c) for e, c in names.items()}
    return df, known


def reach(compiler: Compiler, e: A.Call) -> tuple[Column, int, int] | None:
    """The key as a whole number and how far from it the frame goes, down and up; nothing for other windows."""
    over, frame = e.over, e.over.frame
    if e.name not in MERGED or e.distinct or e.within or frame is None or frame.unit != "RANGE" or len(over.order) != 1:
        return None
    if any(isinstance(b, str) and b != "CURRENT" for b in (frame.start, frame.end)):
        return None
    item = over.order[0]
    kind = compiler.kind(item.expr)
    timed = isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType))
    if not timed and not isinstance(kind, T.IntegralType):
        return None
    if e.name in ("AVG", "AVGIF") and e.args and isinstance(compiler.kind(e.args[0]), T.DecimalType):
        return None
    low, high = (compiler.bound(b, True, timed) for b in (frame.start, frame.end))
    if not item.ascending:
        low, high = -high, -low
    if not isinstance(low, int) or not isinstance(high, int) or low > high or max(-low, high) >= 1 << 60:
        return None
    key = compiler.column(item.expr)
    return F.unix_micros(key.cast("timestamp")) if timed else key.cast("long"), low, high


def _floor_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)) - F.when((a < 0) & (a % F.lit(b) != 0), F.lit(1)).otherwise(F.lit(0))


def _cells(df: DataFrame, compiler: Compiler, over: A.Over, key: Column, low: int, high: int, names: dict[A.Call, str]) -> DataFrame:
    """The key's axis is cut into cells as wide as a frame, so a frame is the end of one cell (near) and the start of
    the next (far). Both are running aggregates. Each row goes to its own cell as near and to the one before as far, and
    asks in the cell its frame begins in; nulls are a cell of their own, and their frame is all of it."""
    width = max(high - low, 1)
    df = df.select("*", key.alias("__key")).select("*", _floor_div(F.col("__key"), width).alias("__cell"), F.pmod("__key", F.lit(width)).alias("__rest"))
    # How many cells from the row's own its frame begins: 0 or 1 before, unless the frame leaves the row out.
    begin = _floor_div(F.col("__rest") + F.lit(low), width)
    copy = lambda off, asks: F.struct(off.cast("long").alias("off"), asks.alias("asks"))
    both = [copy(F.lit(0), begin == 0), copy(F.lit(-1), begin == -1)]
    copies = F.array(*both)
    if low > 0 or high < 0:
        copies = F.when(begin.isin(0, -1), copies).otherwise(F.array(*both, copy(begin, F.lit(True))))
    alone = F.array(copy(F.lit(0), F.lit(True)))
    df = df.select("*", F.explode(F.when(F.col("__key").isNull(), alone).otherwise(copies)).alias("__copy"))
    off = F.col("__copy.off")
    at = (F.col("__rest") - off * F.lit(width)).alias("__at")
    df = df.select("*", (F.col("__cell") + off).alias("__asked"), at, (off == 0).alias("__near"), (off == -1).alias("__far"))
    cell = Window.partitionBy(*map(compiler.column, over.partition), F.col("__asked"))
    near = cell.orderBy(F.col("__at").desc()).rangeBetween(Window.unboundedPreceding, -low)
    far = cell.orderBy(F.col("__at").asc()).rangeBetween(Window.unboundedPreceding, high)
    inner = Compiler(df, compiler.known)
    # The parts are columns first, for windows of one order to be found in one pass.
    parts: dict[str, Column] = {}
    wholes = [_whole(inner, e, near, far, parts, c).alias(c) for e, c in names.items()]
    df = df.select("*", *[c.alias(name) for name, c in parts.items()]).filter("__copy.asks").select("*", *wholes)
    return df.drop("__key", "__cell", "__rest", "__copy", "__asked", "__at", "__near", "__far", *parts)


def _whole(inner: Compiler, e: A.Call, near: WindowSpec, far: WindowSpec, parts: dict[str, Column], prefix: str) -> Column:
    """The aggregate from those of both ends; these are put among the parts, under names with the prefix."""
    name, args = e.name, e.args

    def both(tag: str, make: Callable[[A.Expr], Column]) -> list[Column]:
        for end, spec in (("near", near), ("far", far)):
            role = A.Ref(f"__{end}")
            parts[f"{prefix}_{end}_{tag}"] = make(role if e.where is None else A.Binary("AND", role, e.where)).over(spec)
        return [F.col(f"{prefix}_near_{tag}"), F.col(f"{prefix}_far_{tag}")]

    call = lambda f: lambda where: inner.aggregate(A.Call(f, args, False, where, (), None))
    if name in ("AVG", "AVGIF"):
        inner.aggregate(A.Call(name, args, False, e.where, (), None))  # refuses what it must

        def value(where: A.Expr) -> Column:
            condition = inner.column(where) if name == "AVG" else inner.column(args[1]) & inner.column(where)
            return AGG.masked(inner.number(args[0]).cast("double"), condition)

        sums, counts = both("sum", lambda where: F.sum(value(where))), both("count", lambda where: F.count(value(where)))
        return F.try_divide(_sum(*sums), counts[0] + counts[1])
    if name in _SPREAD:
        inner.aggregate(A.Call(name, args, False, e.where, (), None))
        v, m = both("spread", call("VAR_POP")), both("mean", call("AVG"))
        n = [c.cast("double") for c in both("count", lambda where: F.count(AGG.masked(inner.number(args[0]), inner.column(where))))]
        apart = F.when((n[0] > 0) & (n[1] > 0), (m[0] - m[1]) * (m[0] - m[1]) * n[0] * n[1] / (n[0] + n[1]))
        squares = F.coalesce(_sum(_sum(v[0] * n[0], v[1] * n[1]), apart), F.lit(0.0))
        out = F.try_divide(squares, n[0] + n[1] - 1 if name.endswith("_SAMP") else n[0] + n[1])
        out = F.when(n[0] + n[1] > 0, F.sqrt(out) if name.startswith("STDDEV") else out)
        return out
    a, b = both(name.lower(), call(name))
    if name in ("MIN", "BOOL_AND"):
        return F.least(a, b)
    if name in ("MAX", "BOOL_OR"):
        return F.greatest(a, b)
    kind = inner.df.select(call(name)(A.Literal(True))).schema[0].dataType
    return _sum(a, b).cast(kind)


def _sum(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)
