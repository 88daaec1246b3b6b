"""plinth: a Spark-native analytics engine for event-style tables.

The DataFrame is the intermediate representation: the SQL dialect, the index
functions and the sources all build DataFrame plans and leave physical
planning to Catalyst and adaptive execution.
"""

import sys

from pyspark import cloudpickle

from plinth.config import EngineConfig
from plinth.session import Engine, build_session

# executors need not have the package installed: functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Engine", "EngineConfig", "build_session"]
