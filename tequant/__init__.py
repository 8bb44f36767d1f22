"""tequant: Spark-first quantification of repeat expression, plus corpus operators in ``tequant.llm``."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to the executors by value, so that a cluster without the package on its path can run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
