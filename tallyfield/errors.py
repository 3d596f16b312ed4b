"""Result envelopes for callers that want no exceptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class AnalyticsError(RuntimeError):
    """A request that can't be answered as asked."""


@dataclass
class Result:
    """status OK with a value, or FAILED with errors (operation, message)."""

    status: str
    value: object = None
    errors: list[tuple[str, str]] = field(default_factory=list)

    def text(self) -> str:
        return "\n".join(f"{op}: {message}" for op, message in self.errors)


def enveloped(operation: str, call: Callable, *args, **kwargs) -> Result:
    """Run on the driver; a failure becomes part of the result. Executors' errors are not swallowed:
    they fail the job and arrive here."""
    try:
        return Result("OK", call(*args, **kwargs))
    except Exception as e:  # noqa: BLE001
        return Result("FAILED", None, [(operation, f"{type(e).__name__}: {e}")])


def records(df: DataFrame) -> list[dict]:
    """Rows as dictionaries, NaN as None; for results that a caller shows."""
    return [{k: None if isinstance(v, float) and v != v else v for k, v in r.asDict().items()} for r in df.collect()]
