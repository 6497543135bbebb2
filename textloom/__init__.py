"""Spark-native analytics over collections of free text and the records derived from them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to Python workers by value: executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
