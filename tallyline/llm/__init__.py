"""Operators of a training-data pipeline over documents, pages, conversations and embeddings."""

from pyspark import cloudpickle

import tallyline

# Functions of this package travel to the workers as they are, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(tallyline)
