"""Operators of a training-data pipeline, one module per operator.

Functions of this package travel with their tasks, so that executors need not
have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
