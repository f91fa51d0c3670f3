"""Operators for preparing large text corpora.

Nothing outside this package imports it.  Functions that run inside tasks are
shipped by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
