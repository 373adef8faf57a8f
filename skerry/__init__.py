"""Skerry: a PySpark-native engine for document retrieval, ranking and text analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster's
# workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
