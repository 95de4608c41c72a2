"""Burst-series analytics on Spark: every operator is a DataFrame -> DataFrame function."""

import sys

from pyspark import cloudpickle

from burstseries.session import build_session, scratch_dir

# Task code of this package travels inside the job, so executors need no copy of it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_dir"]
