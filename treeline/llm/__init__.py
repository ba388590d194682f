"""Operators for preparing language-model training data: dedup, PII, quality, scoring, formatting,
packing and byte-level BPE.  Nothing outside this subpackage imports it."""
