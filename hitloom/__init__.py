"""Web-log analytics and corpus building as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
