"""Operators for training-data corpora: de-duplication, classification, personal data, tokens, shards, decontamination.

Nothing else in the library imports this package; its queries are in ``registry``.
"""

import sys

from pyspark import cloudpickle

# Workers get the functions of this package by value, so they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
