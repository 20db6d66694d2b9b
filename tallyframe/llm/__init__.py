"""Operators for training-data pipelines; nothing outside this package imports it.

Functions that run in Python workers are shipped by value, so that workers need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
