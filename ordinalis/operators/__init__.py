"""Query and ingest operators over DataFrames."""
