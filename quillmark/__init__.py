"""quillmark: bibliographic event and provenance analytics as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they run where it is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
