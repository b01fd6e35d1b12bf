"""Counters of fixed size over all rows, summed per block of counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.memory import frugal

#: Counters in one shuffled row.
BLOCK = 1 << 13


def count_hashes(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How many hashes fall on each of 2**bits counters, by their low bits.

    A task sends one array per touched block, so what is shuffled and what reaches the driver
    (4 bytes a counter) has a fixed bound however many rows there are.
    """
    mask, blocks = np.uint64((1 << bits) - 1), max(1, (1 << bits) // BLOCK)
    size = (1 << bits) // blocks

    def tally(batches):
        counts = np.zeros(1 << bits, dtype=np.int32)
        for h in hashes(batches):
            np.add.at(counts, (h & mask).astype(np.int64), 1)
        for k, block in enumerate(np.split(counts, blocks)):
            if block.any():
                narrow = block.astype(np.uint8 if block.max() < 256 else np.int32)  # told apart by their length
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": pa.array([narrow.tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, dtype=np.uint8 if len(raw) == size else np.int32).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, s in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "counts": pa.array([np.minimum(s, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    schema = "block int, counts binary"
    parts = df.mapInArrow(frugal(tally), schema).repartition(min(blocks, 32), "block").mapInArrow(frugal(add), schema)
    total = np.zeros(1 << bits, dtype=np.int32)
    for row in parts.collect():
        total[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["counts"], dtype=np.int32)
    return total


def hashes_of_column(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    """Reader of one 64-bit column for ``count_hashes``; nulls are left out."""
    def read(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(column)).drop_null()
            yield np.asarray(col.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)

    return read
