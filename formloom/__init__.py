"""Outline morphometrics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value: nothing to install there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
