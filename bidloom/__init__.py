"""bidloom: a PySpark-native analytics engine for procurement-scale data.

Everything is a lazy DataFrame plan; Python is used only for the operators that
the built-in expressions cannot express, always in Arrow batches.
"""

import sys

from pyspark import cloudpickle

# Ship our Python operators by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
