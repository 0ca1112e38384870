"""Corpus analytics engine expressed in Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
