"""tickweave: tick-data alignment, features, quality gates and evaluation on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function whose column
names, keys and grid size are parameters.
"""
