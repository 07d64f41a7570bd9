"""tessera: a PySpark-native retrieval analytics engine."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
