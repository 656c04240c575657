"""Market-bar, news and trade analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Python functions with the job: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
