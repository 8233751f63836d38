"""Operators for preparing training data: near duplicates, filters, extraction, mixing and token files."""
