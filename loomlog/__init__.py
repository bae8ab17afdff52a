"""loomlog: analytics over append-only event logs, declared on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel with their code: executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
