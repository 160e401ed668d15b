"""Names taken in turn: of ``x``, ``x_1``, ``x_2``, ... each request gets the first that none before has."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SUFFIXES = r"(?:_[1-9][0-9]*+)++\z"
_VARIANT = re.compile(r"(?s)(.*)_([1-9][0-9]*)\Z")


def root_of(name: Column) -> Column:
    """The name without its numbers; only names with the same root can ever ask for the same name."""
    return F.regexp_replace(name, _SUFFIXES, "")


class Names:
    """What is known of the names of a root: for every name asked for, the next variant it may get.

    All lower variants are taken, by whomever, so one number a name is enough however often it was asked
    for. A name is taken if it was asked for itself, or is a variant that its parent has passed.
    """

    def __init__(self, following: dict[str, int] | None = None):
        self.following = {} if following is None else following

    def take(self, name: str) -> str:
        k = self.following.get(name)
        if k is None:
            variant = _VARIANT.match(name)
            k = int(variant is not None and self.following.get(variant[1], 0) > int(variant[2]))
        while k and f"{name}_{k}" in self.following:
            k += 1
        self.following[name] = k + 1
        return f"{name}_{k}" if k else name


def named_in_turn(requests: DataFrame, name: str, arrival: str, tie: str) -> DataFrame:
    """Adds ``unique_name`` by one ordered pass over every root.

    A task holds the distinct names of one root at a time. A root's requests are all read by one task, so
    this is for roots of bounded size. Rows without a name get none.
    """
    columns = [c for c in requests.columns if c != "unique_name"]
    rows = requests.select(*columns).withColumn("_root", root_of(F.col(name)))
    ordered = rows.repartition("_root").sortWithinPartitions("_root", arrival, tie)
    schema = T.StructType([f for f in requests.schema.fields if f.name != "unique_name"]).add("unique_name", T.StringType())
    at = columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, names = None, Names()
        for batch in batches:
            found = []
            for its_root, asked in zip(batch.column(len(columns)).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if its_root != root:
                    root, names = its_root, Names()
                found.append(None if asked is None else names.take(asked))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*columns, "unique_name"])

    return ordered.mapInArrow(run, schema)
