"""Guarded file sources, parsers' inputs and the versioned snapshot store."""
