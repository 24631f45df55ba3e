"""veritab: record verification against noisy text evidence, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
