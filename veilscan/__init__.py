"""Personal-data discovery on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions with each job, so that executors need no
# copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
