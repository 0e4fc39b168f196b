"""paperlake: paper ingest, vector retrieval and prompt tables as Spark jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns). Importing the package starts nothing.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# numpy and pyarrow but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
