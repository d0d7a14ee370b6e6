"""keyfacet: hybrid retrieval and text processing as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors may lack this package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
