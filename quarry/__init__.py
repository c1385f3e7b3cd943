"""quarry: a domain-driven query engine on PySpark DataFrames."""

__version__ = "0.1.0"
