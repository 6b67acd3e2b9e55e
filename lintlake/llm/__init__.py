"""Operators of a training-data pipeline: scoring, counting, sharding, packing, cleaning.

Their Python functions travel to the workers by value, so a cluster needs no
copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
