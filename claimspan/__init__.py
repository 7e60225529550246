"""claimspan: extract, ground, verify and score claims over documents, as Spark DataFrames."""

__version__ = "0.1.0"
