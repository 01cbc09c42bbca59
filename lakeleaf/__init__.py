"""Spark-native analytics over web archives, document catalogues and text corpora."""

import sys

from pyspark import cloudpickle

# Functions run on executors travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
