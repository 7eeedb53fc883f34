"""stipple: sparse count-matrix analytics as Spark DataFrame jobs.

Everything takes DataFrames and returns DataFrames.  The canonical tables are
described in :mod:`stipple.schema`; operators live in :mod:`stipple.operators`,
readers and writers in :mod:`stipple.sources`, column functions and skew-safe
building blocks in :mod:`stipple.functions`, and the composed analyses in
:mod:`stipple.plans`.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel with their code, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
