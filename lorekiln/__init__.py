"""Semantic-memory analytics on Spark: DataFrame in, DataFrame out, no session at import time."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to the tasks with what they use, so executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
