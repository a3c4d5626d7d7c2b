"""Regional market time series on Spark: reshape, impute, bridge, forecast, map, monitor."""

import sys

from pyspark import cloudpickle

# Ship the few Python task functions by value: executors then need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
