"""ledgermill: document reconciliation and the data processing around it, on Spark DataFrames."""

__version__ = "0.1.0"
