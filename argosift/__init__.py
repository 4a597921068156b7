"""Claim analytics on Spark.

What runs in Python workers is sent along with the query, so executors need not have this package installed.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
