"""Document and text analytics on Spark."""

import sys

from pyspark import cloudpickle

#: Functions travel to the executors whole, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
