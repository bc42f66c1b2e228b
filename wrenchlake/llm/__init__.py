"""Operators that prepare text for training language models.

Nothing else in the library imports this subpackage.  Its functions travel to executors by value, so a cluster needs
numpy, pyarrow and ``regex`` there, but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
