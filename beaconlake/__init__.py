"""Wireless beacon analytics and intrusion detection as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the functions that run inside tasks with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
