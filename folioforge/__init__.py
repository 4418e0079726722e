"""folioforge: document and evidence analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors don't
# need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
