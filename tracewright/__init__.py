"""tracewright: labelled windows, array features and subject-wise evaluation
of long multichannel recordings, as Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames; nothing is
collected inside an operator unless its docstring names the size bound.
"""
