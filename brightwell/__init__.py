"""brightwell: a Spark-native engine for metric early warning over long-format time series.

Its functions travel to the executors by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
