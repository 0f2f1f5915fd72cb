"""Weekly count panels on Spark: features, rolling-origin folds, forecasts, error cubes.

Every operator takes and returns a DataFrame. The unit of work is a *panel*:
one row per (series, Monday). Because that pair is unique, a series never has
more rows than there are Mondays in the calendar span, so windows per series
stay small however large the panel grows; raw facts, where one key may be
arbitrarily hot, are only ever reduced by map-side combined aggregations.
"""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors by value, so that they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
