"""Operators of a training-data pipeline, one module each, with their queries in `queries`.

Functions of this package are shipped to Python workers by value, so a cluster needs no copy of
the repository on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
