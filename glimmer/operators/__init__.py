"""Relational operators of the radar: DataFrame in, DataFrame out."""
