"""Order-insensitive comparison of Spark and DuckDB results, floats within 1e-6."""

import math


def _cell(v):
    if isinstance(v, bool) or v is None:
        return (0, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (1, "nan" if math.isnan(f) else f)
    return (2, str(v))


def _key(row):
    return tuple((t, round(x, 5) if isinstance(x, float) and math.isfinite(x) else str(x)) if t == 1 else (t, x) for t, x in row)


def rows(names, got):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in got]
    return sorted(out, key=lambda r: [(t, str(x)) for t, x in _key(r)])


def assert_same(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for (tx, vx), (ty, vy) in zip(x, y, strict=True):
            if tx == ty == 1 and vx != vy:
                assert math.isclose(vx, vy, rel_tol=1e-6, abs_tol=1e-6), (x, y)
            else:
                assert (tx, vx) == (ty, vy), (x, y)
