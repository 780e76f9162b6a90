"""What can go wrong with a statement."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException, PySparkException


class EngineError(Exception):
    """Base of all errors of the engine."""


class ParseError(EngineError):
    """The text is not a statement of the dialect."""


class PlanError(EngineError):
    """The statement makes no sense: an unknown function, a misplaced aggregate."""


class Unsupported(EngineError):
    """A clause that the dialect leaves out."""


class TableNotFound(EngineError):
    """No table of that name."""


class ColumnMismatch(EngineError):
    """No column of that name."""


class ValueMismatch(EngineError):
    """A row has another number of values than columns, or a value of another type."""


class OperationFailed(EngineError):
    """A write did not come through."""


def of_spark(error: PySparkException) -> EngineError:
    """Spark's error as one of the engine's."""
    text = str(error).splitlines()[0]
    if isinstance(error, AnalysisException):
        condition = error.getCondition() or ""
        if condition.startswith("UNRESOLVED_COLUMN"):
            return ColumnMismatch(text)
        return PlanError(text)
    if isinstance(error, (ArithmeticException, NumberFormatException)):
        return ValueMismatch(text)
    condition = error.getCondition() or ""
    if any(word in condition for word in ("CAST_INVALID", "OVERFLOW", "DIVIDE", "INVALID")):
        return ValueMismatch(text)
    return OperationFailed(text)


def mapped(f: Callable) -> Callable:
    """The function, with Spark's errors as the engine's."""

    @wraps(f)
    def run(*args: object, **given: object) -> object:
        try:
            return f(*args, **given)
        except PySparkException as error:
            raise of_spark(error) from error

    return run
