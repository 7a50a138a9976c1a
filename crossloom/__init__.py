"""Cross-domain recommendation analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
