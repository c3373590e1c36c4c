"""Content-signal analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Python helpers that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
