"""Operators for preparing training text at scale. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get these functions by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
