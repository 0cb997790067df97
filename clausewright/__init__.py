"""Spark-first analytics over versioned document corpora.

Every operator takes DataFrames and returns a lazy DataFrame; the logical plan
is declared with built-in functions and Catalyst picks the physical strategy.
Python appears only where a parser or a numeric kernel has no built-in form,
and then as Arrow batches.
"""

__version__ = "0.1.0"
