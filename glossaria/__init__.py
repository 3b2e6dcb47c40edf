"""Multilingual corpus analytics as plain Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
