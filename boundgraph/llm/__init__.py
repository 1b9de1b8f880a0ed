"""Operators for building training corpora with Spark.

Nothing outside this folder imports it.  Each module holds one operator with its
own general interface; :mod:`boundgraph.llm.queries` applies them to the driver's
tables and derives the columns that the queries return.
"""
