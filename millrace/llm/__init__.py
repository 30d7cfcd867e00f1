"""Operators of a training-data pipeline over a ``documents`` table.

Each module holds one operator with its general interface; ``queries`` registers
the thin queries on top of them. Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
