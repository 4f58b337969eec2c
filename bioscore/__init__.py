"""bioscore: biometric matching analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow kernels are shipped to the executors by value, so that a cluster needs
# no separate installation of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
