"""Conversation analytics on Spark: DataFrame-to-DataFrame operators over many meetings at once."""

import sys

from pyspark import cloudpickle

# The few pandas helpers travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
