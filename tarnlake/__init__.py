"""Tarnlake: Spark jobs for tables of prompts, model responses, scores and token logs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
