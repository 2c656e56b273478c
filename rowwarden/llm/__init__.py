"""Operators for training-data pipelines: filters, scores, near-duplicates, packing.

Nothing else in the library imports this package. Functions that run inside tasks are sent to
the executors by value, so executors need the third-party libraries but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
