"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import canvass
from pyspark import cloudpickle

# Executors get the functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(canvass)
