"""sigspark: DataFrame-native analytics for ordered, multi-channel numeric streams."""

import sys

from pyspark import cloudpickle

# Kernels travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
