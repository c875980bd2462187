"""Operators over frames: presentation, reducers, neighbours, suggestions, sketches."""
