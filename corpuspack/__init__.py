"""Pack large collections of source files into token-budgeted Markdown, on Spark."""

import sys

from pyspark import cloudpickle

from corpuspack.config import PackConfig
from corpuspack.plans.pack import Pack, pack_files, pack_listing

# Functions that run in Python workers travel with the job, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Pack", "PackConfig", "pack_files", "pack_listing"]
