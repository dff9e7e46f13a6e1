"""Operators for training-data pipelines. Nothing else in meshwork imports this subpackage."""
