"""Chart, text and frame analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions of the package travel with the job, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
