"""tidemark: vertical-datum transforms of points and surfaces, as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions and classes travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
