"""gristdex: a document index and query language whose execution engine is Spark.

Postings, summaries and time series are ordinary DataFrames; query expressions
compile to lazy plans that Catalyst optimises.  See README.md.
"""

__version__ = "0.1.0"
