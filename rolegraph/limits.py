"""Row ceiling and deadline of reads."""

from __future__ import annotations

import contextvars
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from rolegraph.lang.tree import ProgramError

MAX_ROWS, SECONDS = 1_000_000, 60.0
_limits: contextvars.ContextVar[tuple[int | None, float | None]] = contextvars.ContextVar("limits", default=(MAX_ROWS, SECONDS))


class LimitProblem(ProgramError):
    pass


@contextmanager
def limits(max_rows: int | None = MAX_ROWS, seconds: float | None = SECONDS) -> Iterator[None]:
    """Other limits for the reads inside the block; None lifts one."""
    token = _limits.set((max_rows, seconds))
    try:
        yield
    finally:
        _limits.reset(token)


def current() -> tuple[int | None, float | None]:
    """The rows and seconds in force."""
    return _limits.get()


def too_many(most: int) -> LimitProblem:
    return LimitProblem(f"the read has more than {most} rows; narrow it with where, keep or limit")


def guarded(spark: SparkSession, df: DataFrame, action: Callable[[DataFrame], list]) -> list:
    """Run an action that returns rows under the limits in force."""
    most, seconds = _limits.get()
    if most is not None:
        df = df.limit(most + 1)
    tag = f"rolegraph-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    spark.addTag(tag)
    if timer:
        timer.start()
    try:
        out = action(df)
    except Exception as e:
        if late.is_set():
            raise LimitProblem(f"the read took more than {seconds:g} seconds; narrow it with where, keep or upto") from e
        raise
    finally:
        if timer:
            timer.cancel()
        spark.removeTag(tag)
    if most is not None and len(out) > most:
        raise too_many(most)
    return out
