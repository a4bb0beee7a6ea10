"""Planner helpers: early outs and broadcast models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def early_out(df: DataFrame, condition: Column, constant: dict[str, Column], kernel: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that meet the condition get constants, only the others go through the kernel."""
    done = df.where(condition).withColumns(constant)
    rest = kernel(df.where(~F.coalesce(condition, F.lit(False))))
    return rest.unionByName(done.select(rest.columns))


def with_model(df: DataFrame, model: Any, kernel: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, tasks: int | None = None) -> DataFrame:
    """Applies kernel(model, rows) to batches; the model is broadcast once. Kernels are slow for a row, so rows are dealt over many tasks."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield kernel(shared.value, rows)

    dealt = df.repartition(tasks) if tasks else df
    return dealt.mapInPandas(run, schema)
