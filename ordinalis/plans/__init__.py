"""Compaction plans over manifest entries, in plain Python: what to merge, and how much work that is."""
