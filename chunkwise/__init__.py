"""chunkwise — build, search and evaluate document corpora on Spark.

Every public function takes DataFrames (plus plain parameters) and returns a
lazy DataFrame; nothing per-document is collected to the driver.

Sub-packages
------------
functions  Column expressions (text normalisation, chunk boundaries, vectors).
sources    Readers and writers (CSV catalogue, text corpora, annotation JSON).
operators  DataFrame operators (chunk, categorize, search, metrics, ...).
plans      End-to-end pipelines (ingest, retrieval and answer evaluation).
streaming  Incremental, replay-safe corpus ingestion.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run in Python workers (pandas UDFs,
# mapInPandas / applyInPandas bodies) are shipped by value, so executors need
# no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from chunkwise.session import get_spark, checkpoint_dir  # noqa: E402,F401

__version__ = "0.1.0"
