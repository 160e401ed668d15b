"""Explicit schemas of the tables that operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

MEMBER = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        # Headers declare sizes as unsigned 64-bit numbers.
        T.StructField("bytes", T.DecimalType(20, 0)),
    ]
)
MEMBER_LISTING = T.StructType([T.StructField("members", T.ArrayType(MEMBER)), T.StructField("error", T.StringType())])

ARCHIVES = "path string, modificationTime timestamp, length bigint, content binary"
EXTRACTED = "repo_id string, path string, is_dir boolean, bytes bigint, content binary, error string"
LISTED = (
    "repo_id string, path string, system string, place string, is_dir boolean, bytes bigint, modified timestamp, "
    "listed boolean"
)
FILES = "repo_id string, path string, bytes bigint, content binary"

PYTHON_SYMBOLS = T.StructType(
    [T.StructField(kind, T.ArrayType(T.StringType())) for kind in ("functions", "classes", "imports")]
    + [T.StructField("error", T.StringType())]
)

PACKAGE_JSON = (
    "name string, version string, description string, dependencies map<string,string>, "
    "devDependencies map<string,string>, engines string"
)
