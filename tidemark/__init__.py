"""Market-event analytics and training-data operators expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to mapInArrow / applyInPandas travel to executors by value,
# so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
