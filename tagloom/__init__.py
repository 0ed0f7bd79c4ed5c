"""Spark toolkit for text corpora that carry inline entity tags such as ``<name:TAG>``."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
