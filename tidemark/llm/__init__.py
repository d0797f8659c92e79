"""Operators for preparing training text: one module per operator, their queries in ``queries``."""

from pyspark import cloudpickle

import tidemark

# Functions for Python workers travel with the plan, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(tidemark)
