"""canvass: a PySpark-native engine that finds coordinated text in large public dockets."""

import sys

from pyspark import cloudpickle

# Executors get the functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
