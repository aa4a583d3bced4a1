"""Composite datasets and the incremental pipeline."""
