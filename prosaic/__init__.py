"""Text analytics for collections of prose, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get this library's functions with each query, so that they needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
