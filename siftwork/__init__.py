"""siftwork: a Spark-native engine for context selection, evidence checking and corpus preparation."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
