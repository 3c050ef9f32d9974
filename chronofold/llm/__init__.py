"""Training-data pipeline operators.

Nothing outside this folder imports it.  Kernels that run inside Python
workers are pickled by value, so an executor needs only the public libraries,
not a copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
