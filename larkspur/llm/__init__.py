"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are shipped to the executors by value, so a cluster does not
need the package installed on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
