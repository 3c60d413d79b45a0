"""Document-collection preparation on Spark DataFrames.

Sub-packages: ``functions`` (Column to Column), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (whole jobs),
``streaming`` (the same work on streams) and ``workloads`` (the queries run
over the shared tables).
"""
