"""Readers and writers: driver tables, snapshots, cards, versioned tables."""
