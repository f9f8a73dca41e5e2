"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage. Its functions run on executors that may not have
the package installed, so they are pickled by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
