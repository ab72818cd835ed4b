"""Operators of a training-data pipeline: token output, filters, duplicates, extraction, scans."""
