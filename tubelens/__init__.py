"""Detection analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (joins, linking,
suppression, graphs, windows), ``sources`` (readers, writers, contracts),
``plans`` (metrics, candidate generation, sweeps, reports) and ``streaming``
(incremental ingest).
"""
import sys

from pyspark import cloudpickle

# Array rules travel to the executors inside the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
