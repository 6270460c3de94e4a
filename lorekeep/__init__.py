"""Knowledge bases, models as tables and context retrieval as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
