"""Analytics over LLM program evaluation runs, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
