"""Training-data operators: dedup, extraction, token output, search, mixing and scoring.

Nothing outside this subpackage imports it.  Its worker functions are pickled
by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
