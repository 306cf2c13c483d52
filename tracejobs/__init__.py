"""PySpark jobs for microservice telemetry and root-cause analysis."""

import sys

from pyspark import cloudpickle

# The functions of pandas and Arrow stages travel with their code, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
