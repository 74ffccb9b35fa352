"""querysmith: enrich a local table by keyword queries against an external one, on Spark.

Functions that run in Python workers are shipped by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
