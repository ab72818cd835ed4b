"""Faultline: root-cause analytics over metrics, traces and logs, as Spark jobs."""

import sys

from pyspark import cloudpickle

# send the small in-task helpers with the job, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
