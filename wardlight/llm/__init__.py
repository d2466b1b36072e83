"""Operators for preparing language-model training data.

Functions that run in Spark's Python workers are sent by value, so workers
need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
