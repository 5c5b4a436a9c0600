"""Pipelines, and the driver queries over lens views of the provided tables."""
