"""Streams beyond the batch engine: alerts as cases arrive."""
