"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Executors get its functions with
the task, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
