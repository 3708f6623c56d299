"""planeflow: frames, packets, palettes, samples and text as Spark DataFrames.

The package is pickled by value, so functions that run in Python workers need no copy of it
on the executors' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
