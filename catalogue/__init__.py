"""Every operator as a query over the given tables, with the same query in SQL."""

import sys

from pyspark import cloudpickle

from . import answers, cells, corpus, ingesting, nested, requests, searching, streams, text, topics
from .base import ORACLES, QUERIES

# Models used by the queries travel with the job, like the package's functions.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ORACLES",
    "QUERIES",
    "answers",
    "cells",
    "corpus",
    "ingesting",
    "nested",
    "requests",
    "searching",
    "streams",
    "text",
    "topics",
]
