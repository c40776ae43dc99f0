"""Document retrieval and answer evaluation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from gleaner.config import RetrievalConfig

# Functions of this package that run inside tasks travel with the job, so executors need no
# installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["RetrievalConfig"]
