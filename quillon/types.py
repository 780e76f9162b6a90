"""SQL type names and the Spark types they stand for."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from quillon.errors import PlanError

#: Names in declarations (fixed values). NUMERIC and DECIMAL without digits are doubles, DATE is a timestamp.
NAMES: dict[str, T.DataType] = (
    {n: T.BooleanType() for n in ("BOOL", "BOOLEAN")}
    | {n: T.LongType() for n in ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "INT64")}
    | {n: T.DoubleType() for n in ("FLOAT", "DOUBLE", "REAL", "NUMERIC", "DECIMAL", "FLOAT64", "DOUBLE PRECISION")}
    | {n: T.StringType() for n in ("VARCHAR", "TEXT", "STRING", "CHAR", "UUID", "INET", "IP")}
    | {n: T.TimestampNTZType() for n in ("TIMESTAMP", "DATETIME", "DATE")}
)


def parse_type(name: str) -> T.DataType:
    """VARCHAR(n) and CHAR(n) are strings; DECIMAL(p, s) is exact."""
    upper = re.sub(r"\s+", " ", name.strip().upper())
    if m := re.fullmatch(r"(\w+) ?\( ?(\d+) ?(?:, ?(\d+) ?)?\)", upper):
        if m[1] in ("DECIMAL", "NUMERIC"):
            return T.DecimalType(int(m[2]), int(m[3] or 0))
        upper = m[1]
    if upper not in NAMES:
        raise PlanError(f"unknown type {name}")
    return NAMES[upper]
