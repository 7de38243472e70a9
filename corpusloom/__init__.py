"""corpusloom: corpus structure and fidelity analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent as code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
