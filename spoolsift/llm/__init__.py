"""Operators for preparing training data: scans, duplicates, tokens, packing and archives."""
