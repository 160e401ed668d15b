"""Sums of matrices over all partitions of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCK = 32
Partial = Callable[[Iterator[pa.RecordBatch]], "np.ndarray | None"]


def summed(rows: DataFrame, partial: Partial, width: int) -> np.ndarray:
    """Sum over all partitions of the matrix that ``partial`` makes of one, ``width`` numbers a row.

    Partitions send their matrix in blocks of rows; a task adds up the blocks of one place as they
    arrive. The driver receives one matrix.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total is not None:
            parts = [total[i : i + _BLOCK].tobytes() for i in range(0, len(total), _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts)], ["block", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(part, dtype="<f8")
                sums[block] = sums[block] + values if block in sums else values
        if sums:
            parts = pa.array([s.tobytes() for s in sums.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), parts], ["block", "part"])

    sent = rows.mapInArrow(blocks, "block int, part binary")
    found = sent.repartition("block").mapInArrow(added, "block int, part binary").collect()
    parts = [np.frombuffer(r.part, dtype="<f8") for r in sorted(found, key=lambda r: r.block)]
    return np.concatenate(parts).reshape(-1, width) if parts else np.zeros((0, width))
