"""CREATE TABLE, INSERT, UPDATE and DELETE over the catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ColumnMismatch, Unsupported, ValueMismatch
from quillon.plans import ast as A
from quillon.plans.expressions import Compiler
from quillon.sources.catalog import Catalog
from quillon.types import parse_type

_TRUE, _FALSE = {"true", "t", "1", "yes", "y"}, {"false", "f", "0", "no", "n"}


def create_table(catalog: Catalog, s: A.CreateTable) -> None:
    schema = T.StructType([T.StructField(n, parse_type(k)) for n, k in s.columns])
    catalog.create(s.name, schema, s.order, s.if_not_exists)


def literal_value(e: A.Expr, kind: T.DataType) -> object:
    """A literal as a value of the column's type; DEFAULT is NULL."""
    if isinstance(e, A.Ref) and e.name.upper() == "DEFAULT":
        return None
    if isinstance(e, A.Cast) and isinstance(e.arg, A.Literal):
        e = e.arg
    if isinstance(e, A.Call) and e.name == "NOW":
        return dt.datetime.now(dt.UTC).replace(tzinfo=None)
    if not isinstance(e, A.Literal):
        raise Unsupported("values other than literals")
    v = e.value
    if v is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
        if isinstance(v, str) and v == "":
            return None
        if isinstance(kind, T.BooleanType):
            text = str(v).lower()
            if text in _TRUE or text in _FALSE:
                return text in _TRUE
            raise ValueError(text)
        if isinstance(kind, T.LongType):
            if isinstance(v, float) and not v.is_integer():
                raise ValueError(v)
            return int(v)
        if isinstance(kind, T.DoubleType):
            return float(v)
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            return Decimal(str(v))
        if isinstance(v, str):
            if v.lower() == "now":
                return dt.datetime.now(dt.UTC).replace(tzinfo=None)
            at = dt.datetime.fromisoformat(v)
            return at.astimezone(dt.UTC).replace(tzinfo=None) if at.tzinfo else at
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(v))
    except (ValueError, ArithmeticError) as error:
        raise ValueMismatch(f"{v!r} is no {kind.simpleString()}") from error


def insert(catalog: Catalog, s: A.Insert) -> int:
    schema = catalog.schema(s.table)
    by_name = {f.name.lower(): f for f in schema.fields}
    names = [n.lower() for n in s.columns] if s.columns is not None else list(by_name)
    for n in names:
        if n not in by_name:
            raise ColumnMismatch(f"no column {n}")
    rows = []
    for row in s.rows:
        if len(row) != len(names):
            raise ValueMismatch(f"{len(row)} values for {len(names)} columns")
        given = {n: literal_value(v, by_name[n].dataType) for n, v in zip(names, row, strict=True)}
        rows.append(tuple(given.get(n) for n in by_name))
    catalog.append(s.table, catalog.spark.createDataFrame(rows, schema), small=True)
    return len(rows)


def key_bounds(where: A.Expr | None, key: tuple[str, T.DataType] | None) -> tuple[object, object] | None:
    """What the condition says of the sort key's first column: least and largest value, both ends included, or
    None if nothing. Only conditions that must all hold are read, so every row that meets the whole is inside."""
    if where is None or key is None:
        return None
    name, kind = key
    low: list = []
    high: list = []

    def literal(e: A.Expr) -> object:
        cast = isinstance(e, A.Cast) and isinstance(e.arg, A.Literal) and parse_type(e.type_name) == kind
        if not (isinstance(e, A.Literal) or cast) or str(getattr(e, "value", "")).lower() == "now" or isinstance(getattr(e, "value", None), bool):
            return None
        if isinstance(kind, T.LongType) and isinstance(e, A.Literal) and isinstance(e.value, float):
            return e.value
        try:
            v = literal_value(e, kind)
        except ValueMismatch:
            return None
        # Other types of literal are compared by other rules than the key's own order.
        return v if isinstance(v, {T.LongType: int, T.DoubleType: float, T.StringType: str, T.TimestampNTZType: dt.datetime}.get(type(kind), ())) else None

    def plain(e: A.Expr) -> bool:
        return not (isinstance(kind, T.StringType) and not (isinstance(e, A.Literal) and isinstance(e.value, str)))

    def take(e: A.Expr) -> None:
        if isinstance(e, A.Binary) and e.op == "AND":
            take(e.left)
            take(e.right)
            return
        if isinstance(e, A.Between) and not e.negated and _is(e.arg, name) and plain(e.low) and plain(e.high):
            a, b = literal(e.low), literal(e.high)
            if a is not None:
                low.append(a)
            if b is not None:
                high.append(b)
        if isinstance(e, A.InList) and not e.negated and _is(e.arg, name):
            values = [literal(i) if plain(i) else None for i in e.items]
            if None not in values:
                low.append(min(values))
                high.append(max(values))
        if isinstance(e, A.Binary) and e.op in ("=", "<", "<=", ">", ">="):
            op, left, right = e.op, e.left, e.right
            if _is(right, name):
                op, left, right = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), right, left
            v = literal(right) if _is(left, name) and plain(right) else None
            if v is not None:
                if op in ("=", ">", ">="):
                    low.append(v)
                if op in ("=", "<", "<="):
                    high.append(v)

    take(where)
    return (max(low, default=None), min(high, default=None)) if low or high else None


def _is(e: A.Expr, name: str) -> bool:
    return isinstance(e, A.Ref) and e.name.lower() == name.lower()


def _targets(catalog: Catalog, table: str, where: A.Expr | None) -> tuple[dict, list[dict], F.Column]:
    """The manifest, the files that hold rows to change (by key range, then by looking), and the condition."""
    m = catalog.read(table)
    files = catalog.matching(m, key_bounds(where, catalog.key_kind(m)))
    if where is None:
        return m, files, F.lit(True)
    hit = F.coalesce(Compiler(catalog.frame(table, m, files)).column(where), F.lit(False))
    return m, catalog.hit_files(table, m, files, hit), hit


def update(catalog: Catalog, s: A.Update) -> None:
    """Copy on write of the files that hold a row to change; the others stay as they are."""
    schema = catalog.schema(s.table)
    fields = {f.name.lower(): f for f in schema.fields}
    for n, _ in s.values:
        if n.lower() not in fields:
            raise ColumnMismatch(f"no column {n}")
    literal = lambda e: isinstance(e, (A.Literal, A.Cast)) or (isinstance(e, A.Ref) and e.name.upper() == "DEFAULT")
    known = {n.lower(): literal_value(e, fields[n.lower()].dataType) for n, e in s.values if literal(e)}
    m, files, hit = _targets(catalog, s.table, s.where)
    if not files:
        return
    df = catalog.frame(s.table, m, files)
    new = {}
    for n, e in s.values:
        kind = fields[n.lower()].dataType
        new[n.lower()] = F.lit(known[n.lower()]).cast(kind) if n.lower() in known else Compiler(df).column(e).cast(kind)
    catalog.rewrite(s.table, m, files, df.select(*[F.when(hit, new[c.lower()]).otherwise(F.col(f"`{c}`")).alias(c) if c.lower() in new else F.col(f"`{c}`") for c in df.columns]))


def delete(catalog: Catalog, s: A.Delete) -> None:
    """Rewrites the files that hold a row to delete, without those rows."""
    m, files, hit = _targets(catalog, s.table, s.where)
    if files:
        catalog.rewrite(s.table, m, files, catalog.frame(s.table, m, files).filter(~hit))
