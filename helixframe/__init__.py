"""Structure analytics and corpus work as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
