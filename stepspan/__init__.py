"""Batch and streaming jobs on Spark for public-transport reachability, accessibility data and training corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
