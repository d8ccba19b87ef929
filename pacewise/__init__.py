"""Keyed-event features, scoring and checks on Spark.

One definition of the per-account velocity features serves historical tables
and live streams; around it sit the aggregates, samples, models, text features
and table comparisons that such a pipeline needs.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions and data sources of this package travel to executors by value, so a
# cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
