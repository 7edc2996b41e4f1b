"""Operators for preparing training text: extraction, cleaning, deduplication, scoring, mixing, encoding.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Ship the code of these modules with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
