"""evalspark: evaluation of generated text, expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers for requests, reports, events, response objects and the driver tables
functions  Column-valued helpers (tokenisers, n-grams, prompt formatting, rounding, ...)
operators  DataFrame -> DataFrame operators (metrics, report, requests, status, outcomes, judge)
plans      end-to-end compositions and the query catalogue used by ``__spark_entry__``
streaming  Structured Streaming twins of the status / completion / scoring operators
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
