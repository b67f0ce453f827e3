"""A PySpark-native engine for document analytics and grounded retrieval."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions that run on executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
