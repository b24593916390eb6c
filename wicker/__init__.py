"""Analytics on wide labelled tables and on training corpora, as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in executors' Python travel with their code: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
