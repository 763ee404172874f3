"""barloom: daily price-panel analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to the tasks carry their code along, so executors need numpy and
# pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
