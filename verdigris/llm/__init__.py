"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors may not have the package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules["verdigris"])
