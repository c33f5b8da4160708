"""Agent-trace analytics on Spark, with training-data operators in :mod:`stepforge.llm`.

Functions that run on executors are pickled by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
