"""Analytics over append-only ledger data, as PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Tasks get the package's functions with their closures, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
