"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Arrow rows are handled in slices of at most this many text bytes, so a batch of long texts stays small.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column``; a longer row stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_slices_at(batch: pa.RecordBatch, at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """As text_slices, for a column given by its place, whatever its name."""
    named, start = pa.RecordBatch.from_arrays([batch.column(at)], ["text"]), 0
    for part in text_slices(named, "text", limit):
        yield batch.slice(start, part.num_rows)
        start += part.num_rows


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Re-cut a stream sorted by ``keys`` so that no group spans two batches.

    Memory: one incoming batch and the largest group; callers bound the size of a group.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k)
            same &= col.to_numpy(zero_copy_only=False) == col[last].as_py()
        differs = np.flatnonzero(~same)
        cut = differs[-1] + 1 if len(differs) else 0
        if kept and cut == 0 and any(kept[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield _joined(kept)
            kept = []
        if cut:
            yield _joined([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield _joined(kept)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]


def group_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Start row of each run of equal keys, and the row count at the end."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


@lru_cache(maxsize=1)
def one_blas_thread() -> bool:
    """Let numpy's matrix products use one thread: matrices here are small, and tasks already use every core."""
    with contextlib.suppress(OSError, AttributeError):
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
        for path in paths:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
                    break
    return True
