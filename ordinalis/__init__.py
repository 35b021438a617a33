"""An append-only ledger store and its query surface, on Spark DataFrames."""
