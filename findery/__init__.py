"""Findery: dense retrieval and its data work as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Task functions travel with their code, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
