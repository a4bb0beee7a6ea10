"""Segments along an axis: change points, best scoring segments, dense windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_points(values: np.ndarray, least: int = 15) -> list[int]:
    """Beginnings of the segments with the smallest sum of squares plus 4 var ln(n) for each segment; no segment is shorter than min(least, n / 4)."""
    n = len(values)
    least = max(1, min(least, n // 4))
    penalty = 4 * float(np.var(values)) * np.log(max(n, 2))
    s, ss = np.concatenate(([0], np.cumsum(values))), np.concatenate(([0], np.cumsum(values**2)))
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    for end in range(least, n + 1):
        start = np.arange(0, end - least + 1)
        cost = best[start] + ss[end] - ss[start] - (s[end] - s[start]) ** 2 / (end - start) + penalty
        k = int(np.argmin(cost))
        best[end], back[end] = cost[k], start[k]
    out, at = [], n
    while at > 0:
        at = int(back[at])
        out.append(at)
    return out[::-1]


def best_segment(scores: np.ndarray) -> tuple[int, int, float]:
    """[start, end) with the largest sum, and the sum."""
    run = np.concatenate(([0.0], np.cumsum(scores)))
    low = np.minimum.accumulate(run[:-1])
    end = int(np.argmax(run[1:] - low)) + 1
    start = int(np.argmin(run[:end]))
    return start, end, float(run[end] - run[start])


def segment_groups(df: DataFrame, key: str, order: str, value: str, least: int = 15) -> DataFrame:
    """(key, segment, first, last, mean) of each group's axis."""
    kind = df.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x, at = rows[value].to_numpy(float), rows[order].to_numpy()
        starts = change_points(x, least)
        ends = [*starts[1:], len(x)]
        return pd.DataFrame({key: rows[key].iloc[0], "segment": range(len(starts)), "first": at[starts], "last": at[np.array(ends) - 1], "mean": [x[a:b].mean() for a, b in zip(starts, ends, strict=True)]})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, segment int, first long, last long, mean double")


def best_segments(df: DataFrame, key: str, order: str, value: str, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """(key, first, last, score, p): the best segment of the centred values, and the share of shuffled axes that do as well."""
    kind = df.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x, at = rows[value].to_numpy(float), rows[order].to_numpy()
        x = x - x.mean()
        a, b, score = best_segment(x)
        rng = np.random.default_rng(seed)
        hits = sum(best_segment(rng.permutation(x))[2] >= score - 1e-12 for _ in range(replicates))
        return pd.DataFrame({key: [rows[key].iloc[0]], "first": [at[a]], "last": [at[b - 1]], "score": [score], "p": [(hits + 1) / (replicates + 1)]})

    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kind}, first long, last long, score double, p double")


def dense_windows(df: DataFrame, flag: Column, keys: list[str], position: str, span: int, share: float) -> DataFrame:
    """Rows that end a window of `span` rows with more flagged rows than by chance: (n - span share) / sqrt(span share (1 - share)) as z."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(-(span - 1), 0)
    hits = df.withColumns({"hits": F.sum(flag.cast("int")).over(w), "_rows": F.count(F.lit(1)).over(w)}).where(F.col("_rows") == span)
    return hits.withColumn("z", (F.col("hits") - span * share) / (span * share * (1 - share)) ** 0.5).drop("_rows")
