"""Operators for large training-text corpora.

Every operator takes and returns DataFrames.  Work inside a task runs in numpy over Arrow batches cut into blocks of
bounded bytes; Spark partitions, shuffles and recovers the work.  Nothing outside this subpackage imports it.
"""
