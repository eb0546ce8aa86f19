"""tallyloom: survey aggregation and outcome simulation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
