"""Equipment telemetry, anomaly and remaining-life analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
