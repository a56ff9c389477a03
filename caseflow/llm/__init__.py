"""Operators for preparing training text at scale; nothing outside this package imports it.

Functions that run in tasks are sent along with them, so executors need only the
libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
