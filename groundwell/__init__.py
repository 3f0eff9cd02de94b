"""Document retrieval and grounding checks as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from .config import Settings
from .session import build_session

# Functions sent to Python workers travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings", "build_session"]
