"""quillgraph: semantic document graphs and text analytics as PySpark programs.

Functions sent to executors are pickled whole, so the executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
