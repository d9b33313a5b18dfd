"""Typed-question analytics on Spark.

Functions of the package are shipped to the executors by value, so they need no copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
