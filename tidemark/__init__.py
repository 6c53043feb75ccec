"""tidemark: web-map analytics as Spark DataFrames.

Sub-packages: ``functions`` (column factories), ``sources`` (table contracts and
readers), ``operators`` (DataFrame to DataFrame), ``plans`` (named queries and
their SQL twins), ``streaming`` (Structured Streaming variants).
"""

__version__ = "0.1.0"
