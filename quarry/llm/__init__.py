"""Operators of a training-data pipeline. Nothing outside this subpackage imports it; the entry module adds its queries where it is present."""
