"""Settlement reconciliation as Spark DataFrame transforms.

Every public operator takes DataFrames and returns DataFrames; batch jobs and Structured Streaming
jobs call the same functions.
"""

__version__ = "0.1.0"
