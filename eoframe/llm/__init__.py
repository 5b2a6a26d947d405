"""Operators for preparing training text at scale.

Functions that run inside Python workers are shipped by value, so executors
need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
