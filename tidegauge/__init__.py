"""Time-series profiling, cleaning and validation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
