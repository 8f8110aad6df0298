"""Lexical atlas on Spark: operators over tables of people, texts, terms and organisations."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package on their path
