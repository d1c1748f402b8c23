"""Readers that bring each source to the shape (doc_id, source, year, grp, title, text, ...), and sinks."""
