"""Paired-read overlap graphs and skew-safe table operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
