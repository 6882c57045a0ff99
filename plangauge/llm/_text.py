"""Arrow helpers shared by the operators that work on batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plangauge.core.columns import others


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part has about `most` bytes of text at the most (a longer text is a part of its own)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
    trim()


def texts(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The text column, null as empty."""
    return pc.fill_null(batch.column(text_col).cast(pa.string()), "")


def with_text_columns(df: DataFrame, text_col: str, fields: list[T.StructField], work: Callable[[pa.Array], list], most: int = 8 << 20) -> DataFrame:
    """df plus `fields`, which work() makes from the texts of a part of a batch; input columns of those names are replaced.

    The other columns travel as one struct, so that any names do.
    """
    names = [f.name for f in fields]
    source = df.select(F.struct(*others(df, *names)).alias("_pg_rec"), F.col(text_col).cast("string").alias("_pg_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_pg_text", most):
            yield pa.RecordBatch.from_arrays([b.column("_pg_rec"), *work(texts(b, "_pg_text"))], ["_pg_rec", *names])

    return source.mapInArrow(run, T.StructType([source.schema["_pg_rec"], *fields])).select("_pg_rec.*", *names)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for every i, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    where = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    where += np.arange(total, dtype=kind)
    return values[where]


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_state: list = [None, None]


def worker_state(key: tuple, build: Callable):
    """What a worker keeps from batch to batch, for one operator at a time: workers are used again by later stages, and another operator's vocabulary or cache would stay in memory."""
    if _state[0] != key:
        _state[:] = [None, None]
        gc.collect()
        trim()
        _state[:] = [key, build()]
    return _state[1]


class Recent:
    """A bounded map that keeps what was used lately: two generations, the older one dropped when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.young[key] = found
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def all(self, keys: list) -> list:
        """get() of each key."""
        out = list(map(self.young.get, keys))
        for i, key in enumerate(keys):
            if out[i] is None and (found := self.old.get(key)) is not None:
                out[i] = self.young[key] = found
        return out
