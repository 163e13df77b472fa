"""Property-listing analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
