"""Corpus and knowledge-base operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job, so the package need not be
# installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
