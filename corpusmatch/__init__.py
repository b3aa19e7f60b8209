"""Find where a catalogue of named patterns occurs in a large source corpus, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Tasks carry the package's functions with them, so the executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
