"""Inspect and clean very large record-line datasets with Spark DataFrames.

Every operator takes a DataFrame and returns a DataFrame.  The usual contract is
``row_id BIGINT`` (0-based line number, or any unique ordering key the caller has)
and ``line STRING`` (one record).
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
