"""Operators that prepare text corpora for language models.

Nothing else in the library imports this package. Functions that run in Python
workers are shipped with the job, so that workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
