"""Text psychometrics on Spark DataFrames.

Every operator is a function from DataFrames to a DataFrame; nothing is collected unless the
collected part has a size that does not grow with the data (a d x d matrix, one row per target).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
