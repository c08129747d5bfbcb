"""Operators for preparing large text corpora: filtering, deduplication, mixing, masking and token output."""
