"""Training-data operators: language, quality, PII, near-duplicates, tokens,
decontamination, mixing, resampling and line dedup over a documents table.

Nothing else in the library imports this subpackage.
"""
