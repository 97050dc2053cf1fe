"""Operators for building training corpora: each module holds one operator.

Nothing outside this subpackage imports it.  ``queries`` registers the thin
``opN_<name>`` queries and the corpus pipeline.
"""

import sys

from pyspark import cloudpickle

# Functions and models travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
