"""Operators for training data: chat formats, quality, deduplication, decontamination, extraction, search and mixing.

Nothing else in the package imports this folder. Its functions are shipped to the workers by value, so workers need
numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
