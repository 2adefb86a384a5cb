"""Spark-native toolkit for image-feature corpora.

Inventory a corpus, split / order / batch it, keep encoded features in a sharded
Parquet store, run latent-space arithmetic, fit and score small mappers, and
query run telemetry -- all as DataFrame programs.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel by value, so workers need not have this
# package installed (a session made elsewhere works without py-files).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
