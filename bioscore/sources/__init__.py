"""Readers and writers for lists, scores, boundaries and rasters."""
