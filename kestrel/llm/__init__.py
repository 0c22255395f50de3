"""Operators of a training-data pipeline; nothing else in the package imports this.

Functions that run in Python workers travel by value, so workers need the
installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
