"""Groups of sorted rows, one at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in their first ``keys`` columns, from batches sorted by these.

    Only the rows of one group are held, whatever the size of the partition.
    """
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        cuts = [0, *(k for k in range(1, len(found)) if found[k] != found[k - 1]), len(found)]
        for first, last in zip(cuts, cuts[1:]):
            if held and found[first] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = found[first]
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)
