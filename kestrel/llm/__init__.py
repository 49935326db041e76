"""Operators of a large-scale training-data pipeline, one module per operator.

``catalog`` registers one thin query per operator; ``corpus_pipeline.py`` at the repository top chains five
of them. Nothing outside this folder imports it.

Functions that run in Python workers are pickled by value, so a cluster needs no copy of this package on its
executors (the libraries they use, numpy, pyarrow and the like, must be installed there).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
