"""Training-data operators: language, fingerprints, dedup, mixing, scoring, tokens.

Nothing outside this subpackage imports it.
"""
