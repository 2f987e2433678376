"""Operators for preparing training data. Nothing outside this package imports it.

Functions that run on executors travel with the plan, so executors need not have this
package installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
