"""Operators on texts and names for training-data pipelines. Nothing outside this subpackage imports it."""
