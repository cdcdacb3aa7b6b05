"""qaspark: API quality-assurance and corpus jobs as plain ``DataFrame -> DataFrame`` functions on Spark."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
