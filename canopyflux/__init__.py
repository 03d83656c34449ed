"""PySpark-native analytics over large collections of per-location time series."""

import os

# Tasks are the unit of parallel work: a linear algebra library must not start threads of its own in each of them.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
