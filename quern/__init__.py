"""quern: matrix programs, execution-trace analytics and training-data operators on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel with their code, so executors need no installation of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
