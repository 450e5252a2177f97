"""Network-flow analytics and attack detection on PySpark."""

import sys

from pyspark import cloudpickle

# the few Python steps travel to the executors with their tasks, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
