"""From expression nodes to Spark columns. One compiler serves every clause."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ColumnMismatch, PlanError, Unsupported
from quillon.functions import aggregates as AGG
from quillon.functions import scalar as S
from quillon.plans import ast as A
from quillon.types import parse_type

RANKING = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist}
_MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_SHORT = {"s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "ms": "millisecond", "us": "microsecond"}
_UNITS = {"second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def walk(e: object):
    """The node and all expressions below it, windows' and filters' included."""
    if isinstance(e, A.Expr):
        yield e
    if isinstance(e, (A.Expr, A.OrderItem, A.Over, A.Frame)):
        for value in vars(e).values():
            yield from walk(value)
    elif isinstance(e, tuple):
        for value in e:
            yield from walk(value)


def is_aggregate(e: object) -> bool:
    return isinstance(e, A.Call) and e.over is None and e.name in AGG.NAMES


def interval_micros(e: A.Expr) -> int:
    """A width: seconds as a number, or text like '5 minutes'. Months and longer have no fixed length."""
    if isinstance(e, A.Literal) and isinstance(e.value, (int, float)):
        return int(e.value * 1_000_000)
    text = e.text if isinstance(e, A.Interval) else e.value if isinstance(e, A.Literal) else None
    if not isinstance(text, str):
        raise PlanError("a width must be a literal")
    total = 0.0
    for number, unit in re.findall(r"([-+]?\d+(?:\.\d+)?)\s*([a-z]*)", text.lower()):
        unit = _SHORT.get(unit, unit.rstrip("s")) or "second"
        if unit not in _MICROS:
            raise Unsupported(f"width in {unit}s")
        total += float(number) * _MICROS[unit]
    if total <= 0:
        raise PlanError(f"not a width: {text!r}")
    return int(total)


def like_pattern(pattern: str, escape: str | None) -> str:
    """The pattern in Spark's form, whose escape is the backslash. Without ESCAPE a backslash is an ordinary character."""
    if escape is not None and len(escape) != 1:
        raise PlanError("ESCAPE takes one character")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape:
            i += 1
            if i == len(pattern):
                raise PlanError("a pattern can't end with its escape")
            c = pattern[i]
            out += "\\" + c if c in "%_\\" else c
        else:
            out += "\\\\" if c == "\\" else c
        i += 1
    return out


class Compiler:
    """Compiles over one frame. `known` maps nodes that exist as columns already (keys, aggregates, aliases)."""

    def __init__(self, df: DataFrame, known: dict[A.Expr, Column] | None = None, tie_break: list[str] | None = None):
        self.df, self.known, self.tie_break = df, known or {}, tie_break or []
        self._fields = {f.name.lower(): f for f in df.schema.fields}
        self._kinds: dict[A.Expr, T.DataType] = {}

    def column(self, e: A.Expr) -> Column:
        if e in self.known:
            return self.known[e]
        method: Callable[[A.Expr], Column] | None = getattr(self, "_" + type(e).__name__.lower(), None)
        if method is None:
            raise Unsupported(type(e).__name__)
        return method(e)

    def kind(self, e: A.Expr) -> T.DataType:
        if isinstance(e, A.Literal):
            return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(e.value), T.NullType())
        if isinstance(e, A.Ref) and e not in self.known and e.name.lower() in self._fields:
            return self._fields[e.name.lower()].dataType
        if isinstance(e, A.Cast):
            return parse_type(e.type_name)
        if e not in self._kinds:
            self._kinds[e] = self.df.select(self.column(e)).schema[0].dataType
        return self._kinds[e]

    def number(self, e: A.Expr) -> Column:
        """Text that holds numbers counts as numbers; other text as NULL."""
        c = self.column(e)
        return c.try_cast("double") if isinstance(self.kind(e), T.StringType) else c

    # --- leaves

    def _ref(self, e: A.Ref) -> Column:
        if e.name.lower() not in self._fields:
            raise ColumnMismatch(f"no column {e.name}")
        return F.col(f"`{self._fields[e.name.lower()].name}`")

    def _literal(self, e: A.Literal) -> Column:
        return F.lit(e.value)

    def _interval(self, e: A.Interval) -> Column:
        return F.expr(f"INTERVAL '{e.text}'")

    # --- operators

    def _unary(self, e: A.Unary) -> Column:
        if e.op == "NOT":
            return ~self.column(e.arg)
        return -self.number(e.arg) if e.op == "-" else self.number(e.arg)

    def _binary(self, e: A.Binary) -> Column:
        op = e.op
        if op in ("AND", "OR"):
            a, b = self.column(e.left), self.column(e.right)
            return a & b if op == "AND" else a | b
        if op == "XOR":
            return self.column(e.left).cast("boolean") != self.column(e.right).cast("boolean")
        if op == "||":
            return F.concat(self.column(e.left).cast("string"), self.column(e.right).cast("string"))
        if op in ("=", "<>", "<", "<=", ">", ">=", "<=>"):
            return self.compare(op, e.left, e.right)
        if op in ("+", "-") and (isinstance(e.right, A.Interval) or isinstance(e.left, A.Interval)):
            a, b = self.column(e.left), self.column(e.right)
            return a + b if op == "+" else a - b
        a, b = self.number(e.left), self.number(e.right)
        if op == "/":
            return S.divide(a, b)
        if op == "%":
            return S.modulo(a, b)
        return {"+": a + b, "-": a - b, "*": a * b}[op]

    def compare(self, op: str, left: A.Expr, right: A.Expr) -> Column:
        a, b = self.comparable(left, right)
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "<=>": a.eqNullSafe(b)}[op]

    def comparable(self, left: A.Expr, right: A.Expr) -> tuple[Column, Column]:
        """Text against a number is compared as a number, against a boolean as text; a text literal takes the other side's type."""
        a, b = self.column(left), self.column(right)
        ka, kb = self.kind(left), self.kind(right)
        text_a, text_b = isinstance(ka, T.StringType), isinstance(kb, T.StringType)
        if text_a == text_b:
            return a, b
        other = kb if text_a else ka
        literal = left if text_a else right
        if isinstance(other, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            if isinstance(literal, A.Literal) and str(literal.value).lower() == "now":
                now = F.current_timestamp().cast("timestamp_ntz")
                return (now, b) if text_a else (a, now)
            return (a.cast(other), b) if text_a else (a, b.cast(other))
        if isinstance(other, T.BooleanType):
            return (a.try_cast("boolean"), b) if text_a else (a, b.try_cast("boolean"))
        if isinstance(other, T.NumericType):
            return (a.try_cast("double"), b) if text_a else (a, b.try_cast("double"))
        return a, b

    def _isnull(self, e: A.IsNull) -> Column:
        c = self.column(e.arg)
        return c.isNotNull() if e.negated else c.isNull()

    def _between(self, e: A.Between) -> Column:
        both = self.compare(">=", e.arg, e.low) & self.compare("<=", e.arg, e.high)
        return ~both if e.negated else both

    def _inlist(self, e: A.InList) -> Column:
        pairs = [self.comparable(e.arg, i) for i in e.items]
        inside = pairs[0][0].isin([b for _, b in pairs]) if len({str(a) for a, _ in pairs}) == 1 else None
        if inside is None:
            inside = pairs[0][0] == pairs[0][1]
            for a, b in pairs[1:]:
                inside |= a == b
        return ~inside if e.negated else inside

    def _match(self, e: A.Match) -> Column:
        text, pattern = self.column(e.arg).cast("string"), e.pattern
        if not isinstance(pattern, A.Literal) or not isinstance(pattern.value, str):
            raise PlanError(f"{e.op} takes a literal pattern")
        if e.op == "RLIKE":
            # A pattern that is none matches nothing.
            out = text.rlike(pattern.value) if self._is_pattern(pattern.value) else F.when(text.isNotNull(), False)
        else:
            quoted = like_pattern(pattern.value, e.escape)
            out = text.like(quoted) if e.op == "LIKE" else text.ilike(quoted)
        return ~out if e.negated else out

    def _is_pattern(self, pattern: str) -> bool:
        try:
            self.df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException:
            return False
        return True

    def _case(self, e: A.Case) -> Column:
        out = None
        for condition, value in e.branches:
            test = self.column(condition) if e.subject is None else self.compare("=", e.subject, condition)
            v = self.column(value)
            out = F.when(test, v) if out is None else out.when(test, v)
        if out is None:
            raise PlanError("CASE without WHEN")
        return out if e.default is None else out.otherwise(self.column(e.default))

    def _cast(self, e: A.Cast) -> Column:
        kind, c = parse_type(e.type_name), self.column(e.arg)
        return c.try_cast(kind) if e.safe else c.cast(kind)

    def _star(self, e: A.Star) -> Column:
        raise PlanError("* stands alone or in COUNT(*)")

    # --- functions

    def _call(self, e: A.Call) -> Column:
        if e.over is not None:
            return self.window(e)
        if is_aggregate(e):
            raise PlanError(f"{e.name} is not allowed here")
        name, args = e.name, e.args
        if name == "TIME_BUCKET":
            return self.time_bucket(args)
        if name == "DATE_TRUNC":
            unit = str(args[0].value).lower().rstrip("s") if len(args) == 2 and isinstance(args[0], A.Literal) else ""
            unit = _SHORT.get(unit, unit)
            if unit not in _UNITS:
                raise Unsupported(f"DATE_TRUNC to {unit or '?'}")
            at = self.column(args[1])
            return S.truncate_time(unit, at.cast("timestamp_ntz") if isinstance(self.kind(args[1]), T.StringType) else at)
        if name == "NOW":
            return F.current_timestamp().cast("timestamp_ntz")
        if name == "COALESCE":
            return F.coalesce(*map(self.column, args))
        numeric: dict[tuple[str, int], Callable[..., Column]] = {
            ("ABS", 1): F.abs,
            ("CEIL", 1): S.ceil,
            ("CEILING", 1): S.ceil,
            ("FLOOR", 1): S.floor,
            ("EXP", 1): F.exp,
            ("LN", 1): S.ln,
            ("LOG", 1): S.log10,
            ("LOG10", 1): S.log10,
            ("LOG", 2): S.log_base,
            ("POWER", 2): F.pow,
            ("POW", 2): F.pow,
            ("ROUND", 1): S.round_away,
            ("WIDTH_BUCKET", 4): S.width_bucket,
        }
        if (name, len(args)) in numeric:
            return numeric[name, len(args)](*map(self.number, args))
        if name == "ROUND" and len(args) == 2:
            digits = args[1].value if isinstance(args[1], A.Literal) and isinstance(args[1].value, int) else self.number(args[1])
            return S.round_away(self.number(args[0]), digits)
        if name in {k for k, _ in numeric}:
            raise PlanError(f"wrong number of arguments for {name}")
        return F.call_function(name.lower(), *map(self.column, args))

    def time_bucket(self, args: tuple[A.Expr, ...]) -> Column:
        if len(args) not in (2, 3):
            raise PlanError("TIME_BUCKET takes a width, a value and perhaps an origin")
        kind = self.kind(args[1])
        if isinstance(kind, T.NumericType):
            return S.bucket_number(self.column(args[1]), interval_micros(args[0]) / 1_000_000, self.number(args[2]) if len(args) == 3 else F.lit(0))
        at = self.column(args[1]).cast("timestamp_ntz")
        width = interval_micros(args[0])
        if len(args) == 2:
            return S.bucket_micros(at, width)
        base = F.unix_micros(self.column(args[2]).cast("timestamp_ntz").cast("timestamp"))
        return S.bucket_micros(at, width, base)

    # --- aggregates

    def aggregate(self, e: A.Call) -> Column:
        where = self.column(e.where) if e.where is not None else None
        name, args = e.name, e.args
        if name == "COUNT":
            if not args or isinstance(args[0], A.Star):
                if e.distinct:
                    raise PlanError("COUNT(DISTINCT *)")
                return F.count(F.lit(1)) if where is None else F.count(F.when(where, 1))
            values = [AGG.masked(self.column(a), where) for a in args]
            return F.count_distinct(*values) if e.distinct else F.count(values[0])
        if name in ("SUMIF", "AVGIF"):
            self._arity(e, 2)
            condition = self.column(args[1]) if where is None else self.column(args[1]) & where
            return (F.sum if name == "SUMIF" else F.avg)(AGG.masked(self.number(args[0]), condition))
        if name == "COUNTIF":
            self._arity(e, 1)
            return F.count_if(self.column(args[0]) if where is None else self.column(args[0]) & where)
        if name in ("PERCENTILE_CONT", "PERCENTILE_DISC"):
            value = e.within[0].expr if e.within else args[1] if len(args) == 2 else None
            if value is None or not isinstance(args[0], A.Literal) or not 0 <= float(args[0].value) <= 1:
                raise PlanError(f"{name} takes a literal between 0 and 1 and a value")
            c, down = AGG.masked(self.number(value), where), bool(e.within) and not e.within[0].ascending
            if name == "PERCENTILE_CONT":
                return AGG.percentile_cont(1 - float(args[0].value) if down else float(args[0].value), c)
            return AGG.percentile_disc(Decimal(str(args[0].value)), c, down)
        if name == "APPROX_QUANTILE":
            self._arity(e, 2)
            return AGG.quantile_lower(AGG.masked(self.number(args[0]), where), float(args[1].value))
        self._arity(e, 1)
        c = AGG.masked(self.number(args[0]) if name in AGG.NUMERIC else self.column(args[0]), where)
        if e.distinct and name in ("SUM", "AVG"):
            return F.sum_distinct(c) if name == "SUM" else F.sum_distinct(c) / F.count_distinct(c)
        if e.distinct and name not in ("MIN", "MAX"):
            raise Unsupported(f"{name}(DISTINCT)")
        return AGG.SIMPLE[name](c)

    def _arity(self, e: A.Call, n: int) -> None:
        if len(e.args) != n:
            raise PlanError(f"{e.name} takes {n} argument{'s' * (n > 1)}")

    # --- windows

    def sort(self, item: A.OrderItem, c: Column | None = None) -> Column:
        """Nulls come last going up and first going down, unless it is said."""
        c = self.column(item.expr) if c is None else c
        first = self.nulls_first(item)
        if item.ascending:
            return c.asc_nulls_first() if first else c.asc_nulls_last()
        return c.desc_nulls_first() if first else c.desc_nulls_last()

    def nulls_first(self, item: A.OrderItem) -> bool:
        return item.nulls_first if item.nulls_first is not None else not item.ascending

    def window(self, e: A.Call) -> Column:
        over, name = e.over, e.name
        assert over is not None
        if e.distinct or e.within:
            raise Unsupported("DISTINCT or WITHIN GROUP in a window")
        spec: WindowSpec = Window.partitionBy(*map(self.column, over.partition))
        timed = over.frame is not None and over.frame.unit == "RANGE" and len(over.order) == 1 and isinstance(self.kind(over.order[0].expr), (T.TimestampNTZType, T.TimestampType, T.DateType))
        # A RANGE frame over time counts in microseconds.
        order = [self.sort(i, F.unix_micros(self.column(i.expr).cast("timestamp")) if timed else None) for i in over.order]
        ranged = over.frame is not None and over.frame.unit == "RANGE" or name in ("RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST")
        named = {i.expr.name.lower() for i in over.order if isinstance(i.expr, A.Ref)}
        ties = [] if ranged else [F.col(f"`{c}`").asc_nulls_last() for c in self.tie_break if c.lower() not in named]
        if name in ("RANK", "DENSE_RANK") and not order:
            raise PlanError(f"{name} needs ORDER BY")
        if order or (name == "ROW_NUMBER" and ties):
            spec = spec.orderBy(*order, *ties)
        elif name == "ROW_NUMBER" or name in ("LAG", "LEAD"):
            spec = spec.orderBy(F.lit(1))
        if name in RANKING:
            c = RANKING[name]().over(spec)
            return c.cast("long") if name in ("ROW_NUMBER", "RANK", "DENSE_RANK") else c
        if name == "NTILE":
            return F.ntile(int(e.args[0].value)).over(spec).cast("long")
        if name in ("LAG", "LEAD"):
            return self.shift(e, spec)
        if order:
            spec = self.framed(spec, over.frame, timed)
        if name in ("FIRST_VALUE", "LAST_VALUE"):
            return (F.first_value if name == "FIRST_VALUE" else F.last_value)(self.column(e.args[0])).over(spec)
        if name in AGG.NAMES:
            plain = A.Call(name, e.args, False, e.where, (), None)
            return self.aggregate(plain).over(spec)
        raise Unsupported(f"{name} as a window function")

    def framed(self, spec: WindowSpec, frame: A.Frame | None, timed: bool = False) -> WindowSpec:
        """Without a frame: all rows before and the current one."""
        if frame is None:
            return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        start, end = (self.bound(b, frame.unit == "RANGE", timed) for b in (frame.start, frame.end))
        return spec.rowsBetween(start, end) if frame.unit == "ROWS" else spec.rangeBetween(start, end)

    def bound(self, b: A.Expr | str, ranged: bool, timed: bool) -> int:
        """Rows, or units of the key; over time, and as an INTERVAL, seconds."""
        if b == "CURRENT":
            return Window.currentRow
        if isinstance(b, str):
            return Window.unboundedPreceding if b.endswith("PRECEDING") else Window.unboundedFollowing
        width = b.arg if isinstance(b, A.Unary) else None
        if isinstance(width, A.Interval) and ranged or timed:
            zero = isinstance(width, A.Literal) and width.value == 0
            micros = 0 if zero else interval_micros(width)
            n = micros if timed else micros / 1_000_000
        elif isinstance(width, A.Literal) and isinstance(width.value, (int, float)):
            n = width.value
        else:
            raise Unsupported("frame bounds other than numbers and, in RANGE, intervals")
        n = int(n) if float(n).is_integer() else n
        return -n if b.op == "PRECEDING" else n

    def shift(self, e: A.Call, spec: WindowSpec) -> Column:
        offset = 1
        if len(e.args) > 1:
            if not isinstance(e.args[1], A.Literal) or not isinstance(e.args[1].value, int) or e.args[1].value < 0:
                raise PlanError(f"{e.name} takes a whole offset from 0")
            offset = e.args[1].value
        c = self.column(e.args[0])
        if len(e.args) > 2 and isinstance(self.kind(e.args[2]), T.StringType):
            c = c.cast("string")  # a text default makes the whole column text
        value = (F.lag if e.name == "LAG" else F.lead)(c, offset).over(spec)
        if len(e.args) < 3:
            return value
        # The default is taken where there is no such row, at the current row; a NULL in that row stays.
        there = (F.lag if e.name == "LAG" else F.lead)(F.lit(1), offset).over(spec)
        return F.when(there.isNotNull(), value).otherwise(self.column(e.args[2]))
