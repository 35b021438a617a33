"""Structured Streaming: ingest into a ledger, and the block log as a stateful stream."""
