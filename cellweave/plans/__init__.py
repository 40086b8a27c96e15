"""Strategies for lineage capture, what they cost, and which to choose."""
