"""Incremental scan of arriving source files."""
