"""Operators for text corpora: scoring, near copies, decontamination, mixing and sharding."""

import sys

from pyspark import cloudpickle

# Functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
