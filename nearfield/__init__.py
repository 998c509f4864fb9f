"""nearfield: semantic search over tables, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Per-batch helpers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
