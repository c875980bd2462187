"""Incremental maintenance of indexes and sketches."""
