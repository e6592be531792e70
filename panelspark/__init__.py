"""panelspark: PySpark jobs that turn large, loosely described tables into linked panels."""

import sys

from pyspark import cloudpickle

# Python code that runs inside tasks travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
