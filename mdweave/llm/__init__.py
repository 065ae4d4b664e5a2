"""Operators for training-data pipelines (tokenizing, dedup, quality, secrets,
packing, archives).  Nothing else in the package imports this subpackage."""
