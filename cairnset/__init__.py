"""Spark-native similarity, selection and evaluation engine for large compound collections."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers carry their code along, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
