"""Operators that prepare training text: tokens, packing, duplicates, licences, quality, privacy,
archives, languages and embeddings.

Each module has a general DataFrame interface; ``queries`` applies them to whole tables.  The code
that runs inside tasks is sent to the executors with the task, so nothing has to be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
