"""Build long column expressions once per column name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession, functions as F


def reusable(build: Callable[..., Column]) -> Callable[..., Column]:
    """Let a column function take names as well, and keep what it built for them.

    An expression over names is unresolved until a DataFrame uses it, so one
    expression serves every DataFrame that has such columns. Building a long one
    takes hundreds of calls into the JVM, which adds up in a loop of waves.
    """
    built: dict[tuple, Column] = {}

    @wraps(build)
    def call(*args: Column | str) -> Column:
        columns = [F.col(a) if isinstance(a, str) else a for a in args]
        session = SparkSession.getActiveSession()
        if session is None or not all(isinstance(a, str) for a in args):
            return build(*columns)
        key = (session.sparkContext.applicationId, *args)
        if key not in built:
            built[key] = build(*columns)
        return built[key]

    return call
