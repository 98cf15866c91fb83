"""Peaks along a track."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def peaks(y: np.ndarray, pad: int, least: float) -> Iterator[tuple[int, float]]:
    """Places of the greatest value, again and again after its surroundings are struck out, down to `least`; the first of equal ones."""
    y = np.array(y, float)
    while len(y):
        i = int(y.argmax())
        if y[i] < least or y[i] == -np.inf:
            return
        yield i, float(y[i])
        y[max(0, i - pad) : i + pad + 1] = -np.inf


def greedy_peaks(tracks: DataFrame, key: str, values: str, pad: int, least: float) -> DataFrame:
    """(key, at, height) for each row's track; each peak depends on those before it, so a row is worked through in one go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, height = [], [], []
            for k, y in zip(batch.column(0), batch.column(1)):
                for i, v in peaks(np.asarray(y.values) if y.is_valid else np.empty(0), pad, least):
                    keys.append(k.as_py())
                    at.append(i)
                    height.append(v)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(height, pa.float64())], names=[key, "at", "height"])

    return tracks.select(tracks[key].cast("long").alias(key), values).mapInArrow(work, f"{key} long, at int, height double")
