"""Training-data operators: ten corpus operations built on Spark.

Nothing outside this subpackage imports it.  Its functions run inside Python
workers, so they are pickled by value: a cluster then needs no copy of the
repository on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
