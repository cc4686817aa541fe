"""Text analytics on Spark DataFrames: spoken-form normalisation of Ukrainian text, segmentation, and corpus operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
