"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that one call of a grouped Python function should get; groups are made so many that this holds.
BUCKET_ROWS = 40_000


def batches(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` holds about ``size`` characters each."""
    lens = batch.column(column)
    import pyarrow.compute as pc

    n = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, x in enumerate(n):
        if total and total + x > size:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += int(x) + 1
    if lo < batch.num_rows:
        yield batch.slice(lo, batch.num_rows - lo)


def per_chunk(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", size: int = 1 << 18):
    """A mapInArrow function that calls f on slices of about ``size`` characters, so memory is independent of batch sizes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in batches(batch, column, size):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever others there are; names are matched exactly first, so ``Text`` beside ``text`` is no clash."""
    at: dict[str, int] = {}
    for n in names:
        exact = [i for i, c in enumerate(df.columns) if c == n]
        near = exact or [i for i, c in enumerate(df.columns) if c.lower() == n.lower()]
        if not near:
            raise ValueError(f"no column {n}")
        at[n] = near[0]
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    by = {i: n for n, i in at.items()}
    return df.toDF(*(by.get(i, f"_other{i}") for i in range(len(df.columns)))).select(*names)


def buckets(rows: int, most: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // most))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and one past the last column of every run of True in a matrix."""
    m, n = flags.shape
    edge = np.zeros((m, n + 1), np.int8)
    edge[:, :n] = flags
    step = np.diff(edge, axis=1, prepend=np.int8(0))
    r, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return r, a, b
