"""PySpark-native analytics for industrial sensor data."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
