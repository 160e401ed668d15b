"""Python workers: values kept across tasks, and the size of their batches.

Functions of this library travel with the job, so their modules' globals are new in every task. Models
and vocabularies that take long to load are kept under a name in the process instead.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark.sql import SparkSession

Value = TypeVar("Value")


def kept(key: Hashable, make: Callable[[], Value]) -> Value:
    """The value made for ``key`` in this process, made now if it is the first use."""
    shelf = sys.modules.setdefault("_repoquarry_kept", types.ModuleType("_repoquarry_kept")).__dict__
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def small_batches(spark: SparkSession) -> None:
    """Let tasks exchange batches of at most 1,000 rows or 8 MB with Python from now on in this session.

    Rows here are whole texts; the usual 10,000 of them can take hundreds of megabytes on either side.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
