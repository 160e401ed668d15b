"""Spark-native analytics over collections of source-code repositories."""

import sys

from pyspark import cloudpickle

from repoquarry.options import ReportOptions, ScanOptions

# Functions of this package travel to the executors with the job, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ReportOptions", "ScanOptions"]
