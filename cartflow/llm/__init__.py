"""Operators for large text corpora: encoding, scoring, deduplication, decontamination and search."""
