"""Structured Streaming versions of the loads, the dedup and the attribution."""
