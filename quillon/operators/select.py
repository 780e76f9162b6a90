"""SELECT: scan, WHERE, grouping, HAVING, windows, QUALIFY, order, projection, DISTINCT, OFFSET and LIMIT."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import ColumnMismatch, PlanError, Unsupported
from quillon.operators.sliding import slide
from quillon.plans import ast as A
from quillon.plans.expressions import Compiler, is_aggregate, walk

#: Up to this OFFSET, without LIMIT, the rows to drop are found by the keys of the last of them; for more, Spark sorts all rows in one task.
MOST_SKIPPED = 100_000


def output_names(items: list[A.SelectItem], columns: list[str]) -> list[str]:
    names = []
    for item in items:
        names.append(item.alias or (item.expr.name if isinstance(item.expr, A.Ref) else item.text))
    return names


def _expand(q: A.Select, columns: list[str]) -> list[A.SelectItem]:
    out: list[A.SelectItem] = []
    for item in q.items:
        if isinstance(item.expr, A.Star):
            out += [A.SelectItem(A.Ref(c), None, c) for c in columns]
        else:
            out.append(item)
    return out


def substitute(e: object, names: dict[str, A.Expr], columns: set[str]) -> object:
    """References to aliases become what the aliases stand for; columns of the table come first."""
    if isinstance(e, A.Ref):
        return names[e.name.lower()] if e.name.lower() in names and e.name.lower() not in columns else e
    if isinstance(e, (A.Expr, A.OrderItem, A.Over, A.Frame)):
        return replace(e, **{k: substitute(v, names, columns) for k, v in vars(e).items()})
    if isinstance(e, tuple):
        return tuple(substitute(x, names, columns) for x in e)
    return e


def run_select(df: DataFrame, q: A.Select, tie_break: list[str] | None = None) -> DataFrame:
    columns = {c.lower() for c in df.columns}
    items = _expand(q, df.columns)
    aliases = {i.alias.lower(): i.expr for i in items if i.alias}
    resolve = lambda e: substitute(e, aliases, columns)
    if q.where is not None:
        if any(is_aggregate(e) or (isinstance(e, A.Call) and e.over) for e in walk(q.where)):
            raise PlanError("WHERE holds no aggregates or windows")
        df = df.filter(Compiler(df).column(q.where))
    order = [replace(o, expr=items[o.expr.value - 1].expr) if _ordinal(o.expr, len(items)) else replace(o, expr=resolve(o.expr)) for o in q.order]
    having = resolve(q.having) if q.having is not None else None
    qualify = resolve(q.qualify) if q.qualify is not None else None
    used = [i.expr for i in items] + [o.expr for o in order] + [e for e in (having, qualify) if e is not None]
    if q.group or any(is_aggregate(e) for u in used for e in walk(u)):
        df, known = _group(df, q, items, used, aliases)
        compiler = Compiler(df, known)
        if having is not None:
            df = df.filter(compiler.column(having))
    elif having is not None:
        raise PlanError("HAVING without groups")
    else:
        compiler = Compiler(df, tie_break=tie_break)
    df, slid = slide(df, compiler, used)
    if slid:
        compiler = Compiler(df, compiler.known | slid, compiler.tie_break)
    names = output_names(items, df.columns)
    outs = [compiler.column(i.expr) for i in items]
    sorts = [compiler.column(o.expr) for o in order]
    temp = [c.alias(f"__out_{k}") for k, c in enumerate(outs)] + [c.alias(f"__sort_{k}") for k, c in enumerate(sorts)]
    if qualify is not None:
        temp.append(compiler.column(qualify).alias("__qualify"))
    told = bool(compiler.tie_break) and not q.distinct
    if q.offset and told:
        named = {o.expr.name.lower() for o in order if isinstance(o.expr, A.Ref)}
        temp += [F.col(f"`{c}`").alias(f"__tie_{k}") for k, c in enumerate(compiler.tie_break) if c.lower() not in named]
    df = df.select(*temp)
    if qualify is not None:
        df = df.filter("__qualify")
    final = [F.col(f"__out_{k}") for k in range(len(outs))]
    if q.distinct:
        places = [next((k for k, i in enumerate(items) if i.expr == o.expr), None) for o in order]
        if None in places:
            raise Unsupported("DISTINCT ordered by a column that isn't selected")
        df = df.select(*final).distinct()
        keys = [f"__out_{k}" for k in places]
    else:
        keys = [f"__sort_{k}" for k in range(len(order))]
    if order:
        sorts = [(c, o.ascending, compiler.nulls_first(o)) for o, c in zip(order, keys, strict=True)]
        if q.offset and q.limit is None and q.offset <= MOST_SKIPPED:
            df, sorts = _skip(df, sorts, q.offset, told)
        df = df.orderBy(*[_sort(*s) for s in sorts])
    df = df.select(*final)
    if q.offset and (not order or q.limit is not None or q.offset > MOST_SKIPPED):
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df.toDF(*names)


def _sort(name: str, ascending: bool, nulls_first: bool) -> Column:
    c = F.col(name)
    if ascending:
        return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()


def _skip(df: DataFrame, sorts: list[tuple[str, bool, bool]], n: int, told: bool) -> tuple[DataFrame, list[tuple[str, bool, bool]]]:
    """The rows after the first n, in no order, and the sort keys that tell them. Only the first n rows' keys meet in one
    task. Ties go by the table's key if it has one, else by the row's hash; what ties even so is dropped by number."""
    ties = [c for c in df.columns if c.startswith("__tie_")]
    if not told:
        plain = [F.col(f.name) for f in df.schema.fields if f.name.startswith("__out_") and not re.search("map<|variant", f.dataType.simpleString())]
        df, ties = df.withColumn("__hash", F.xxhash64(*plain) if plain else F.lit(0)), ["__hash"]
    sorts = list(dict.fromkeys(sorts + [(c, True, False) for c in ties]))
    names = list(dict.fromkeys(c for c, _, _ in sorts))
    first = df.select(*names).orderBy(*[_sort(*s) for s in sorts]).limit(n)
    edge = first.groupBy(*names).agg(F.count(F.lit(1)).alias("__dropped")).withColumn("__found", F.sum("__dropped").over(Window.partitionBy()))
    edge = edge.orderBy(*[_sort(c, not up, not nulls) for c, up, nulls in sorts]).limit(1)
    edge = edge.select(*[F.col(c).alias(f"__edge{c}") for c in names], "__dropped", "__found")
    # With fewer than n rows in all, none is left.
    both = df.crossJoin(F.broadcast(edge)).filter(F.col("__found") == n)
    same, after = F.lit(True), F.lit(False)
    for c, up, nulls in sorts:
        a, b = F.col(c), F.col(f"__edge{c}")
        beyond = F.coalesce(a > b if up else a < b, (a.isNotNull() & b.isNull()) if nulls else (a.isNull() & b.isNotNull()))
        after, same = after | (same & beyond), same & a.eqNullSafe(b)
    numbered = both.filter(same).withColumn("__number", F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1))))
    rest = both.filter(after).select(*df.columns).unionByName(numbered.filter("__number > __dropped").select(*df.columns))
    return rest, sorts


def _ordinal(e: A.Expr, count: int) -> bool:
    if not isinstance(e, A.Literal) or isinstance(e.value, bool) or not isinstance(e.value, int):
        return False
    if not 1 <= e.value <= count:
        raise PlanError(f"no column {e.value} to sort or group by")
    return True


def _group(df: DataFrame, q: A.Select, items: list[A.SelectItem], used: list[A.Expr], aliases: dict[str, A.Expr]) -> tuple[DataFrame, dict[A.Expr, Column]]:
    columns = {c.lower() for c in df.columns}

    def key(e: A.Expr) -> A.Expr:
        return items[e.value - 1].expr if _ordinal(e, len(items)) else substitute(e, aliases, columns)

    sets: list[tuple[A.Expr, ...]] = [()]
    for g in q.group:
        sets = [s + tuple(map(key, alternative)) for s in sets for alternative in g.sets]
    keys = list(dict.fromkeys(e for s in sets for e in s))
    if any(is_aggregate(e) for k in keys for e in walk(k)):
        raise PlanError("a group key holds no aggregate")
    before = Compiler(df)
    found = list(dict.fromkeys(e for u in used for e in walk(u) if is_aggregate(e)))
    df = df.select("*", *[before.column(k).alias(f"__key_{n}") for n, k in enumerate(keys)])
    before = Compiler(df)
    made = [before.aggregate(e).alias(f"__agg_{n}") for n, e in enumerate(found)]
    name = {k: f"__key_{n}" for n, k in enumerate(keys)}
    plain = [F.col(c) for c in name.values()]
    if len(sets) == 1:
        grouped = df.groupBy(*plain) if keys else None
    else:
        grouped = df.groupingSets([[F.col(name[e]) for e in dict.fromkeys(s)] for s in sets], *plain)
    if grouped is None:
        out = df.agg(*made) if made else df.select(F.lit(1).alias("__agg_none")).limit(1)
    else:
        out = grouped.agg(*made) if made else grouped.agg(F.count(F.lit(1)).alias("__agg_none"))
    known: dict[A.Expr, Column] = {k: F.col(c) for k, c in name.items()}
    known |= {e: F.col(f"__agg_{n}") for n, e in enumerate(found)}
    for u in used:
        _check(u, known)
    return out, known


def _check(e: object, known: dict[A.Expr, Column]) -> None:
    """Every column outside aggregates must be a key."""
    if isinstance(e, A.Expr) and e in known:
        return
    if isinstance(e, A.Ref):
        raise ColumnMismatch(f"{e.name} is neither grouped by nor aggregated")
    if isinstance(e, (A.Expr, A.OrderItem, A.Over, A.Frame)):
        for value in vars(e).values():
            _check(value, known)
    elif isinstance(e, tuple):
        for value in e:
            _check(value, known)
