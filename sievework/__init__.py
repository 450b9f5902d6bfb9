"""sievework: governed text-corpus preparation and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their tasks, so that the package needs to be
# installed, or on a path, on the driver alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
