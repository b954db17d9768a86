"""Operators of a training-data pipeline: mixing, fingerprints, joins, scoring, tokenising and formatting.

What their Arrow functions use is sent to the executors with the tasks, which need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
