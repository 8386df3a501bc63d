"""quillspark: document analytics and retrieval as lazily planned Spark pipelines."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so a cluster needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
