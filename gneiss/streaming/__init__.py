"""Structured Streaming extension of the maintenance operators."""
