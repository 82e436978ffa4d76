"""Operators that prepare training data for language models.

One module per operator; ``queries`` holds the registered queries and their
SQL.  Nothing outside this folder imports it.  Every operator takes and
returns DataFrames, selects the columns it needs first (so further columns, of
whatever name, do no harm) and treats a null text as an empty one.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
