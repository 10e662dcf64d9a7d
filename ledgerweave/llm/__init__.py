"""Operators for large training-text collections, their queries and their SQL.

Nothing outside this subpackage imports it, apart from the guarded registration in
``__spark_entry__.py`` and the pipeline module at the repository top.
"""

import sys

from pyspark import cloudpickle

# Task code is sent by value: executors need the libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
