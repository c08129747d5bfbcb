"""Table wrangling and profiling expressed as Spark DataFrame transforms.

Every public function takes DataFrames and returns DataFrames; scalars are returned
only where the result is a handful of numbers (bounds, counts, labels).
"""
import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their task, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
