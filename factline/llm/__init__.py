"""Operators for preparing training text; nothing else in the library imports this subpackage."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions travel to the executors inside the task, so that a cluster needs no installation of this package
register_pickle_by_value(sys.modules[__name__])
