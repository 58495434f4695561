"""Operators of a training-data pipeline over the documents, embeddings and conversations tables."""

from pyspark import cloudpickle

import threadwise

# Functions that run in Python workers travel by value: the workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(threadwise)
