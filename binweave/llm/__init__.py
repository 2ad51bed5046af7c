"""Operators for preparing training text at scale.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
