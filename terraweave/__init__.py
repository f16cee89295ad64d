"""terraweave: text-to-spatial-graph analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few helpers that run inside tasks travel with the job, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
