"""Operators for large text corpora used to train language models.

Functions of this package that run on executors are pickled by value, so that workers
need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
