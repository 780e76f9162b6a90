"""The engine: query() for SELECT, execute() for all statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.errors import PlanError, TableNotFound, Unsupported, mapped
from quillon.operators import dml
from quillon.operators.select import run_select
from quillon.plans import ast as A
from quillon.plans.parser import parse
from quillon.sources.catalog import Catalog


class Engine:
    """SQL over tables of a catalog folder and over registered frames; both are plain DataFrames underneath."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, root) if root else None
        self.frames: dict[str, tuple[DataFrame, list[str]]] = {}

    def register(self, name: str, df: DataFrame, key: list[str] | None = None) -> Engine:
        """Make a frame a table; key: columns that tell its rows apart, used to break ties in windows."""
        self.frames[name.lower()] = (df, key or [])
        return self

    def table(self, name: str, where: A.Expr | None = None) -> tuple[DataFrame, list[str]]:
        """The table's frame and key; of a catalog table only the files whose key range the condition meets."""
        if name.lower() in self.frames:
            return self.frames[name.lower()]
        if self.catalog is None:
            raise TableNotFound(f"no table {name}")
        m = self.catalog.read(name)
        bounds = dml.key_bounds(where, self.catalog.key_kind(m))
        return self.catalog.frame(name, m, self.catalog.matching(m, bounds)), m["sort_key"]

    @mapped
    def query(self, sql: str) -> DataFrame:
        """The frame of a SELECT. What goes wrong while it is made is an EngineError; what goes wrong when its
        rows are fetched is Spark's own error (rows() and the shell map that, too)."""
        statement = parse(sql)
        if not isinstance(statement, A.Select):
            raise PlanError("query() takes SELECT")
        if statement.table is None:
            raise Unsupported("SELECT without a table")
        df, key = self.table(statement.table, statement.where)
        return run_select(df, statement, key)

    @mapped
    def rows(self, sql: str) -> list:
        """The rows of a SELECT."""
        return self.query(sql).collect()

    @mapped
    def execute(self, sql: str) -> DataFrame | None:
        statement = parse(sql)
        if isinstance(statement, A.Select):
            return self.query(sql)
        if self.catalog is None:
            raise Unsupported("statements that write, without a catalog folder")
        run = {A.CreateTable: dml.create_table, A.Insert: dml.insert, A.Update: dml.update, A.Delete: dml.delete}
        run[type(statement)](self.catalog, statement)
        return None

    def table_names(self) -> list[str]:
        return sorted({*self.frames, *(self.catalog.names() if self.catalog else [])})

    def flush_table(self, name: str) -> None:
        """Writes are complete when execute() returns; kept so that callers need not change."""
        self.table(name)
