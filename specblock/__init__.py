"""Block-coefficient image analytics on Spark DataFrames.

Functions of this package are shipped to executors by value, so that a
cluster needs numpy, pyarrow and PySpark only, not an installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
