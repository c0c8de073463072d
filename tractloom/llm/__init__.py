"""Operators of a training-data pipeline: scoring, filtering, matching, redaction and encoding of texts."""
