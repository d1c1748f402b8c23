"""Streaming forms of the cube: the same results as in batch once the watermark has passed."""
