"""Operators of a training-data pipeline. Nothing else in strandline imports this subpackage."""
