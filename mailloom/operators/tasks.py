"""User tasks: functions from DataFrame to DataFrame, run in order with an early stop per message."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class TaskRegistry:
    """Named ``DataFrame -> DataFrame`` tasks."""

    tasks: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def task(self, name: str) -> Callable:
        def register(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            self.tasks[name] = fn
            return fn

        return register

    def run(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.tasks:
            raise KeyError(f"no task named {name!r}")
        return df.transform(self.tasks[name])


@dataclass(frozen=True)
class Step:
    """``output`` is what the step reports, ``go_on`` whether later steps still run."""

    name: str
    output: Column
    go_on: Column | bool = True


def run_steps(df: DataFrame, steps: list[Step], *keys: str) -> DataFrame:
    """One row per (message, step) that ran; a false ``go_on`` ends the list for that message.

    All steps of a message are computed in one pass over its row.
    """
    running, reports = F.lit(True), []
    for i, step in enumerate(steps, start=1):
        report = F.struct(
            F.lit(i).cast("bigint").alias("step"), F.lit(step.name).alias("task"), step.output.alias("output")
        )
        reports.append(F.when(running, report))
        go_on = F.lit(step.go_on) if isinstance(step.go_on, bool) else F.coalesce(step.go_on, F.lit(False))
        running = running & go_on
    return df.select(*keys, F.inline(F.array_compact(F.array(*reports))))


def custom_handler(fn: Callable[..., pd.Series], *columns: str) -> Column:
    """Boolean column from a user function over pandas Series, in Arrow batches; null counts as false."""

    @F.pandas_udf("boolean")
    def handler(row: pd.DataFrame) -> pd.Series:
        return fn(*(row[c] for c in columns)).astype("boolean").fillna(False).astype(bool)

    return handler(F.struct(*columns))


def row_task(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Row code that needs Python, applied to Arrow batches inside the tasks."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)
