"""Operators for preparing training data: search, decontamination, deduplication, scoring, packing, redaction."""
