"""Operators of a training-data pipeline; nothing else in ``vigil`` imports this subpackage."""
