"""Operators for training-data text: repair, redaction, deduplication, leakage, mixing, segmentation.

Nothing outside this subpackage imports it.
"""
