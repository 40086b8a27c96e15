"""Training-data operators: decontamination, joins, codecs, filters and scans.

Nothing outside this folder imports it; the entry module adds its queries only
when the folder is there. Worker functions travel by value, so executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
